"""The pipeline against plain Python: each stage recomputed by comparing everything with everything."""

import random
import re

import corpus_pipeline
from quillspark.llm import decontaminate, jaccard, lines, quality, simhash
from tests_plain import plain_drops, plain_targets


def test_pipeline_like_plain_python(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "PARTS", 1)
    rng = random.Random(41)
    lexicon = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(700)]

    def prose(n):
        return " ".join(rng.choice(lexicon) for _ in range(n)).capitalize() + "."

    passage, notice = prose(58), prose(7)
    items = [(i, prose(30)) for i in range(6)]
    rows = []
    for i in range(70):
        parts = [prose(rng.randint(12, 30)) for _ in range(rng.randint(3, 6))]
        if i % 5 == 0:
            parts.insert(1, notice)
        if i % 23 == 0:
            parts.append(passage)
        if i % 11 == 3:
            words = items[i % 6][1].split()
            words[4] = "changed"
            parts.append(" ".join(words))
        rows.append((i, "\n".join(parts)))
    for k in range(12):  # copies with an edit or two
        words = re.split(r"(\s)", rows[k][1])
        words[2 * rng.randrange(len(words) // 2)] = "edited"
        rows.append((100 + k, "".join(words)))
    rows += [(120, rows[7][1]), (121, None), (122, "")]
    rows += [(200 + i, " ".join(w.upper() + "!!#" for w in prose(60).split())) for i in range(25)]
    rng.shuffle(rows)
    sources = {i: f"s{i % 4}" for i, _ in rows}
    docs = spark.createDataFrame([(i, t, "en", sources[i], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    scores = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    texts = {i: t for i, t in rows if scores[i] >= quality.ACCEPT}
    drops = plain_drops([(i, t or "") for i, t in texts.items()])
    texts = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drops.get(i, ())) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints, sets = {i: simhash.fingerprint(t) for i, t in texts.items()}, {i: jaccard.shingles(t) for i, t in texts.items()}
    for a in texts:
        for b in texts:
            bits = bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1")
            if a < b and (bits <= 2 or (len(sets[a]) and len(sets[b]) and jaccard.similarity(sets[a], sets[b]) >= 0.8)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    texts = {i: t for i, t in texts.items() if find(i) == i}
    hashes = decontaminate.token_hashes
    tests = [hashes(t) for _, t in items]
    texts = {i: t for i, t in texts.items() if not any(decontaminate.overlap(hashes(t), y, g) for y in tests for g in range(-len(y), len(hashes(t)) + 1))}

    sizes, taken, times = {}, {}, {}
    for i, t in texts.items():
        sizes[sources[i]] = sizes.get(sources[i], 0) + len((t or "").split())
    for r in got:
        assert r.text == texts[r.doc_id] and r.source == sources[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    assert 40 < len(texts) < 80 and max(times.values()) <= 3
    for s, target in plain_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= max(40, 0.03 * target)
        if target >= sizes[s]:
            assert {i for i in texts if sources[i] == s and (texts[i] or "").split()} <= set(times)
