"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, operator by operator."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, jaccard, lines, mixing, quality, simhash, sitestyle, warc
from quillspark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, and names of their results.
CLASHES = (
    "key", "__key", "__own", "__drop", "__dropped", "__source", "__plan", "__place", "__at", "mix", "out_key", "keep_id", "keep_key", "fp", "root", "node", "bucket", "sig", "leaf", "block",
    "a", "b", "n", "text_key", "component_id", "score", "held_out", "size", "target", "sha", "last", "payload", "host", "low", "high", "__url", "__k", "__id",
)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randint(0, 60)) for _ in range(n))


def frame(spark, rows, clashes=True):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)]) if clashes else df


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(21)
    shared = words(rng, 60)
    rows = [(i, f"{words(rng, 40)}\n{shared}\n{words(rng, 30)}", f"s{i % 3}") for i in range(12)]
    rows += [(50, None, "s0"), (51, "", None), (52, " \n\t", "s1"), (None, "no id here", "s1"), (None, None, None), rows[3], rows[3]]
    rows += [(60, "x " * 400_000 + "end", "s2"), (61, "q" * 700_000, "s2")]
    return rows


STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "never seen words of a test item that nobody quotes"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_any_table(spark, odd, tables, name):
    """Clashing names, odd and repeated rows, empty tables: nothing breaks, columns and other values stay."""
    docs = frame(spark, odd)
    out = STAGES[name](spark, docs, tables)
    assert out.columns[: len(docs.columns)] == docs.columns
    kept = out.collect()
    assert all(r[c] == k for r in kept for k, c in enumerate(CLASHES))
    assert {r.doc_id for r in kept} <= {i for i, *_ in odd}
    if name != "source_mixing":
        assert out.columns == docs.columns and sum(r.doc_id is None for r in kept) == 2
    nothing = STAGES[name](spark, docs.limit(0), tables)
    assert nothing.collect() == [] and nothing.columns == out.columns


def test_rows_are_judged_by_their_own_text(spark):
    """Rows that share an id and differ in text part: neither is lost for the other's sake."""
    rng = random.Random(5)
    a, b, c = (words(rng, 80) for _ in range(3))
    rows = [(1, a, "s"), (1, b, "s"), (5, a, "s"), (5, c, "s"), (5, c, "s")]
    docs = frame(spark, rows)
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_representatives(docs).collect())
    assert kept[0][0] == 1 and {t for i, t in kept if i == 1} <= {a, b}
    same = sorted((r.doc_id, r.text) for r in simhash.keep_representatives(docs, first_rows=jaccard.first_rows(docs)).collect())
    assert {t for _, t in same} == {a, b, c} and len([t for _, t in same if t == a]) == 1 and len([t for _, t in same if t == c]) == 1
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert sorted((r.doc_id, r.text) for r in decontaminate.keep_clean(docs, items).collect()) == sorted((i, t) for i, t, _ in rows if t != a)


def test_components_like_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, k) for k in range(400, 480)] + [(7, 7), (901, 901), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_near_copies_like_brute_force(spark):
    """Links by five-word similarity of 0.8 among copies with edits all over: groups as by all pairs."""
    rng = random.Random(3)
    base = words(rng, 150).split()
    texts = []
    for _ in range(160):
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(150)] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [words(rng, 100) for _ in range(20)] + ["one two", "ONE two", "", " "]
    rows = list(enumerate(dict.fromkeys(texts)))
    sets = {i: jaccard.shingles(t) for i, t in rows}
    edges = [(i, j) for i, x in sets.items() for j, y in sets.items() if i < j and len(x) and len(y) and jaccard.similarity(x, y) >= 0.8]
    ddl = "a long, b long"
    want = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, ddl)).collect()}
    found = jaccard.links(spark.createDataFrame(rows, "node long, text string")).collect()
    assert {tuple(r) for r in found} <= set(edges) and len(found) < 20 * len(rows)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([tuple(r) for r in found], ddl)).collect()}
    assert sum(got.get(i, i) != want.get(i, i) for i, _ in rows) <= 2


def test_decontamination_like_brute_force(spark):
    """Every document and item, every diagonal: the seeds lose no overlap that counts."""
    rng = random.Random(4)
    items = [(i, " ".join(f"t{rng.randrange(9)}" for _ in range(rng.choice([3, 8, 11, 15, 20, 40])))) for i in range(25)]
    docs = []
    for k in range(60):
        own = [f"t{rng.randrange(9)}" for _ in range(rng.randrange(0, 90))]
        item = items[rng.randrange(25)][1].split()
        for _ in range(rng.randrange(0, 1 + len(item) // 3)):
            item[rng.randrange(len(item))] = "other"
        at = rng.randrange(len(own) + 1)
        docs.append((k, " ".join(own[:at] + item + own[at:]), "s"))
    hashes = decontaminate.token_hashes
    want = set()
    for d, text, _ in docs:
        x = hashes(text)
        for i, other in items:
            y = hashes(other)
            if max(decontaminate.overlap(x, y, g) for g in range(-len(y), len(x) + 1)):
                want.add((d, i))
    table = spark.createDataFrame(items, "item_id long, text string")
    for broadcast in (10**6, 0):
        found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame(spark, docs), table, broadcast_seeds=broadcast).collect()}
        assert found == want and want


def test_very_long_texts(spark):
    """Texts of megabytes go through whole: what stands at their ends counts."""
    rng = random.Random(6)
    body = words(rng, 150_000)
    leak = words(rng, 40)
    rows = [(1, f"{body} {leak}", "s"), (2, f"{body} other end", "s"), (3, leak, "s")]
    docs = frame(spark, rows, clashes=False)
    assert [r.doc_id for r in decontaminate.keep_clean(docs, spark.createDataFrame([(1, leak)], "item_id long, text string")).collect()] == [2]
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in simhash.keep_representatives(docs, first_rows=jaccard.first_rows(docs)).collect()) == [1, 3]
    mixed = {r.doc_id: r.size for r in mixing.mix(docs).collect()}
    assert mixed == {1: 150_040, 2: 150_002, 3: 40}
    dropped = {r.doc_id: r["__dropped"] for r in lines.drop_recurring(docs).collect()}
    assert dropped == {1: 0, 2: 0, 3: 0}
    assert np.isfinite(quality.statistics(rows[0][1])).all()


def test_long_pages_and_archives(spark, tmp_path):
    body = "<p>" + "word " * 300_000 + "</p>"
    page = f"<html><body><nav>menu</nav><article><h1>Head</h1>{body}<p>last</p></article></body></html>"
    pages = [(1, "http://a.org/1", page, 5), (2, "http://a.org/2", page, 5), (3, None, None, 5), (None, "http://a.org/x", "<article>z</article>", 5)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, sha long").select("*", F.lit(1).alias("last"), F.lit(2).alias("payload"), F.lit(3).alias("bytes"))
    texts = {r.page_id: r.text for r in sitestyle.extract(table).collect()}
    assert texts[1] == texts[2] and texts[1].startswith("Head\n\nword word") and texts[1].endswith("\n\nlast") and texts[3] == "" and texts[None] == "z"
    back = {r.page_id: r for r in warc.round_trip(spark, table, f"file://{tmp_path}").collect()}
    assert back[1].record_type == "revisit" and back[1].refers_to == 2 and back[2].payload_digest == hashlib.sha1(page.encode()).hexdigest() == back[1].payload_digest
    assert back[3].payload_bytes == 0 and back[None].record_type == "response"
    assert sitestyle.extract(table.limit(0)).collect() == []


def test_style_nodes_by_broadcast_or_by_join(spark):
    rng = random.Random(15)
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<body><div class='zz'><p>Every page of host {i % 3} says this.</p></div><div class='c'><p>{words(rng, 30)}</p></div></body>") for i in range(24)]
    table = spark.createDataFrame(rows + [(50, None, rows[0][2])], "page_id long, url string, html string")
    by_broadcast = sorted(map(tuple, sitestyle.extract(table).collect()), key=str)
    by_join = sorted(map(tuple, sitestyle.extract(table, broadcast_nodes=0).collect()), key=str)
    assert by_broadcast == by_join and all("Every page" not in t for i, _, t in by_join if i < 24) and len(by_join) == 25


@pytest.mark.parametrize("budget", [0, 32 << 20])
def test_revisits_without_a_broadcast(spark, tmp_path, monkeypatch, budget):
    """The plan for many shared digests gives what the plan for few does."""
    monkeypatch.setattr(warc, "BROADCAST_BYTES", budget)
    rows = [(i, f"u{i}", ("payload %d " % (i % 3)) * 200) for i in range(9)] + [(8, "again", "payload 2 " * 200), (None, "n", "payload 1 " * 200)]
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}").collect())
    assert got == sorted([(str(i), "response", None) if i > 5 else (str(i), "revisit", 6 + i % 3) for i in range(9)] + [("8", "response", None), ("None", "response", None)])


def test_frequent_fingerprints_and_lines_join_apart(spark, monkeypatch):
    from quillspark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(11)
    same = words(rng, 30)

    def plain():  # a token with a digit is a variable field
        return " ".join("".join(rng.choices("abcdefghijklm", k=6)) for _ in range(20))

    rows = [(i, same, "s") for i in range(30)] + [(100 + i, f"{plain()}\nthe same closing line of every page here\n{plain()}", "s") for i in range(20)] + [(200, "", "s"), (201, None, "s")]
    docs = frame(spark, rows, clashes=False)
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(classes[i] == 0 for i in range(30)) and classes[201] == 200
    out = {r.doc_id: r["__dropped"] for r in lines.drop_recurring(docs).collect()}
    assert sum(out.values()) == 19 and out[100] == 0


def test_a_broken_run_goes_on_after_its_last_finished_stage(spark, odd, tables, tmp_path, monkeypatch):
    frame(spark, odd, clashes=False).write.parquet(f"{tables}/documents.parquet")
    folder, calls = f"file://{tmp_path}/run", []

    def counted(name, stage):
        def call(*args):
            calls.append(name)
            if name == "benchmark_decontamination" and calls.count(name) == 1:
                raise RuntimeError("an executor too many was lost")
            return stage(*args)

        return name, call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*x) for x in corpus_pipeline.STAGES])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, tables, folder)
    again = corpus_pipeline.run(spark, tables, folder)
    assert calls == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "benchmark_decontamination", "source_mixing"]
    assert {r.doc_id for r in again.collect()} <= {i for i, *_ in odd}
