import hashlib
import random

import pytest

from quillspark.llm import suffix


def brute(rows):
    out = []
    first: dict[bytes, int] = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            first[s] = min(doc_id, first.get(s, doc_id))
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < doc_id:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("block_bytes", "piece_bytes"), [(3000, 1 << 24), (500, 120), (1 << 24, 77)])
def test_like_brute_force(spark, block_bytes, piece_bytes):
    rng = random.Random(5)
    words = ["the", "of", "é", "anble", "tion", "\n", "x" * 60]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    passage = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30))
    texts += [f"a{i} {passage[i : i + 60 + i]} z{i}" for i in range(40)]
    texts += [texts[3], texts[3], texts[41], None, "", "y" * 49, "y" * 50, "y" * 50, "y" * 51, "y" * 200]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows.append(rows[5])
    got = suffix.substring_dedup(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(3), block_bytes=block_bytes, piece_bytes=piece_bytes).drop("spans").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_edges(spark):
    assert suffix.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "q" * 80), (1, "q" * 80)]
    got = {r.doc_id: r.n_removed for r in suffix.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: 0, 1: 0}


def test_one_very_long_text(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=5000))
    body = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=6_000_000))
    long = body + passage + body[::-1][:4_000_000] + passage
    rows = [(1, passage), (2, long), (3, long), (4, "x" + long[5_999_000:6_001_000])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = long.replace(passage, "")
    assert got[1] == (5000, 0, 0, hashlib.sha256(passage.encode()).hexdigest())
    assert got[2] == (len(long), 10_000, 2, hashlib.sha256(kept.encode()).hexdigest())
    assert got[3] == (len(long), len(long), 1, hashlib.sha256(b"").hexdigest())
    assert got[4] == (2001, 2000, 1, hashlib.sha256(b"x").hexdigest())
