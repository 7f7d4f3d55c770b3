import hashlib
import math
import random

import numpy as np
import pytest

from quillspark.llm import yinyang

DDL = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """Lloyd rounds with Python's integers and all distances, for vectors of one length that ``parts`` divides."""
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def apart(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((apart(c[p], w), e) for e, w in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o[p][1] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = assign()
    errors = [sum(d for d, _ in o) for o in own]
    digest = hashlib.sha256(",".join(str(x) for b in books for w in b for x in w).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{e:02x}" for _, e in o), err, by_label[label], digest) for (i, _, label), o, err in zip(kept, own, errors, strict=True)]


def coded(spark, rows, ddl=DDL, **more):
    return sorted((tuple(r) for r in yinyang.compress(spark.createDataFrame(rows, ddl), **more).collect()), key=repr)


def sample(n=400, d=32, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (12, d))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.05, d)).astype(np.float32).tolist(), [None, 1, 2, 3][i % 4]) for i in range(n)]
    # Coarse vectors tie all the time.
    return rows + [(n + i, rng.integers(-2, 3, d).astype(np.float32).tolist(), 7) for i in range(n)]


def test_equals_plain_version_with_ties_and_unusable_vectors(spark):
    rows = sample()
    random.Random(1).shuffle(rows)
    rows += [(9000, None, 1), (9001, [None] * 32, 1), (9002, [float("nan")] * 32, 1), (9003, [float("inf")] * 32, 2), rows[5], rows[5], (None, rows[0][1], None)]
    assert coded(spark, rows) == sorted(plain_codes(rows), key=repr)


def test_fewer_vectors_than_entries_and_no_vectors(spark):
    rows = sample(9)
    assert coded(spark, rows) == sorted(plain_codes(rows), key=repr)
    assert coded(spark, [(1, None, 1)]) == [] and yinyang.compress(spark.createDataFrame([], DDL)).collect() == []
    one = coded(spark, [(1, [0.5] * 16, None)])
    assert [r[:4] for r in one] == [(1, "00" * 16, 0, 0)]


def test_other_lengths_have_their_own_codebooks(spark):
    rows = sample(60)
    short = [(20_000 + k, [k / 10, -k / 7, 0.3], 50) for k in range(5)] + [(30_000, [], 51)]
    got = coded(spark, rows + short)
    assert [r for r in got if r[0] < 20_000] == sorted(plain_codes(rows), key=repr)
    padded = plain_codes([(i, v + [0.0] * 13, label) for i, v, label in short if v])
    assert [r for r in got if 20_000 <= r[0] < 30_000] == padded
    assert [r for r in got if r[0] == 30_000][0][1:4] == ("00" * 16, 0, 0)


def test_huge_components_are_held_and_clashing_columns_ignored(spark):
    rows = [(k, [3e38 * (-1) ** k, *[0.1 * k] * 31], 1) for k in range(70)]
    frame = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS id", "2 AS code", "3 AS own", "4 AS n", "5 AS vector")
    got = sorted(yinyang.compress(frame).collect())
    assert len(got) == 70 and all(r.error >= 0 for r in got)
    assert coded(spark, rows, parts=1, entries=256) and pytest.raises(ValueError, yinyang.compress, frame, entries=257)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_never_hide_a_nearer_or_tied_entry(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-40, 41, (500, 3)) if seed % 2 else rng.integers(-3, 4, (500, 3))
    words = x[:40].copy()
    groups = yinyang.cluster(words, 5)
    own, upper, lower = yinyang.first_assignment(x, words, groups)
    scanned = 0
    for _ in range(6):
        upper, lower = yinyang._narrow(upper, True).astype(float), yinyang._narrow(lower, False).astype(float)
        new = words + rng.integers(-2, 3, words.shape) * (rng.random(len(words)) < 0.3)[:, None]
        moved = np.sqrt(((new - words) ** 2).sum(1)) * (1 + 1e-9)
        words = new
        own, upper, lower, n = yinyang.next_assignment(x, words, groups, moved, own, upper, lower)
        scanned += n
        assert (own == ((x[:, None] - words[None]) ** 2).sum(2).argmin(1)).all()
    if seed % 2:
        assert scanned < 6 * 500 * lower.shape[1] * 0.8  # bounds spare scans


def test_half_precision_bounds_are_rounded_outwards():
    values = np.concatenate([np.linspace(-50, 90_000, 4001), [np.inf, 0.0, 1e-9, -1e-9]])
    assert (yinyang._narrow(values, True).astype(float) >= values).all()
    assert (yinyang._narrow(values, False).astype(float) <= values).all()
