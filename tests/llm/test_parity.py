import random

import numpy as np
import pytest

from quillspark.llm import parity
from quillspark.llm.jaccard import shingles

DDL = "doc_id long, text string"


def plain_sets(text, words=4):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def plain_classes(rows, words=4, per_cent=85):
    """Sizes and components by comparing all pairs."""
    sets = [plain_sets(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= per_cent * (len(sets[i]) + len(sets[j]) - shared):
                    root[find(i)] = find(j)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        out.append((doc_id, len(sets[k]), min(ids) if ids and sets[k] else doc_id))
    return sorted(out, key=repr)


def classes(spark, rows, **more):
    return sorted((tuple(r) for r in parity.similarity_classes(spark.createDataFrame(rows, DDL), **more).collect()), key=repr)


def edited(rng, words, share):
    return [f"new{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words]


def family_rows(seed, families=6, members=14):
    """Families whose members are edited more and more, around a passage that all documents share."""
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for f in range(families):
        base = [f"f{f}w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 9, 30, 120, 300, 700]))]
        for _ in range(members):
            body = edited(rng, base, rng.choice([0, 0.005, 0.02, 0.03, 0.045]))
            rows.append((len(rows), " ".join(body[: len(body) // 2] + common * (f % 2) + body[len(body) // 2 :])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [(1024, 48 << 20), (5, 48 << 20), (1024, 40_000)])
def test_equals_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(parity, "CELL_SETS", cells[0])
    monkeypatch.setattr(parity, "CELL_BYTES", cells[1])
    rows = family_rows(sum(cells))
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "One two"), (9004, "one TWO"), (9005, "one"), (None, rows[0][1]), (None, "nobody else says this at all"), rows[3], rows[3]]
    assert classes(spark, rows) == plain_classes(rows)


def test_chains_of_close_sets_hang_together(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(40):  # each is close to the one before, the ends share nothing
        rows.append((k, " ".join(words)))
        words = [*words[6:], *(f"n{rng.randint(0, 10**6)}" for _ in range(6))]
    got = classes(spark, rows)
    assert got == plain_classes(rows) and {r[2] for r in got} == {0}


def test_other_lengths_and_similarities(spark):
    rows = family_rows(8, 4)
    assert classes(spark, rows, words=2, per_cent=70) == plain_classes(rows, 2, 70)


def test_long_texts_clashing_columns_and_empty_table(spark):
    rng = random.Random(2)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:110_000])), (3, " ".join(long[:60_000])), (4, "a " * 300_000), (5, "a a a a")]
    frame = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS node", "2 AS text_key", "3 AS key", "4 AS n", "5 AS component_id")
    assert sorted(tuple(r) for r in parity.similarity_classes(frame).collect()) == plain_classes(rows)
    assert parity.similarity_classes(frame.where("false")).collect() == []


def test_sketches_bound_differences_from_below():
    rng = random.Random(1)
    for _ in range(40):
        a = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(4, 700))]
        b = edited(rng, a, 0.05) + ["tail"] * rng.randint(0, 60)
        x, y = shingles(" ".join(a), 4), shingles(" ".join(b), 4)
        rows = parity._words([parity.sketch(x), parity.sketch(y)])
        assert np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(np.setxor1d(x, y))


def test_linked_sets_always_share_a_posting():
    rng = random.Random(6)
    tried = 0
    for n in [*range(4, 60), 100, 140, 141, 333, 1000, 3000]:
        for _ in range(6):
            a = rng.sample(range(1, 1 << 62), n)
            shared = rng.randint(-(-85 * n // 100), n)
            b = a[:shared] + [rng.randrange(1, 1 << 62) for _ in range(rng.randint(0, max(0, shared * 100 // 85 - n)))]
            x, y = np.unique(np.array(a, np.uint64)), np.unique(np.array(b, np.uint64))
            if parity.linked(x, y) and len(np.setxor1d(x, y)):
                tried += 1
                assert len(np.intersect1d(parity.postings(x), parity.postings(y)))
    assert tried > 100


def test_bands_hold_all_sizes_that_link():
    for n in range(1, 3000):
        for m in range(-(-85 * n // 100), n + 1):
            assert set(parity.bands_of(n)) & set(parity.bands_of(m)), (n, m)


def test_repeated_names_take_another_seed(spark, monkeypatch):
    real = parity._name
    monkeypatch.setattr(parity, "_name", lambda tokens, seed: (7, real(tokens, seed)[1]) if seed == 0 else real(tokens, seed))
    rows = family_rows(3, 2, 4)
    assert len(classes(spark, rows)) == len(rows)
