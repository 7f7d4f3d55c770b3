import io
import re
import struct
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillspark.functions import markdown
from quillspark.operators import lineage, paragraphs, profiler, retrieval, segments
from quillspark.session import TABLES
from quillspark.sources import files
from quillspark.streaming import folds, segmentation

SMALL = "/root/testdata/sf0.001"


def seg(rows):
    return [("s", k, text, 2.0 * k, 2.0 * k + 1) for k, text in enumerate(rows)]


SEG = "session string, ordinal long, text string, start double, end double"


def test_boundaries(spark):
    rows = seg(["This is a first sentence about cats.", "However, dogs bark loudly at night.", "dogs bark and go on", "w " * 130 + "end", "next one"])
    got = {r.after: r for r in paragraphs.boundary_candidates(spark.createDataFrame(rows, SEG)).collect()}
    assert got[0].enabled and got[0].transition and got[0].sentence and got[0].topic_shift
    assert not got[1].enabled and not got[2].enabled
    assert got[3].long and got[3].enabled


def test_long_pause_and_sentence_end_split(spark):
    rows = [("s", 0, "It is so.", 0.0, 1.0), ("s", 1, "It is so again.", 3.0, 4.0), ("s", 2, "It is so too.", 5.0, 6.0)]
    got = {r.after: r.enabled for r in paragraphs.boundary_candidates(spark.createDataFrame(rows, SEG)).collect()}
    assert got == {0: True, 1: False}


def test_locks_survive_and_tombstones_stay(spark):
    turns = spark.createDataFrame(seg([f"part {k} goes on" for k in range(6)]), SEG)
    auto = paragraphs.boundary_candidates(turns)
    none = spark.createDataFrame([], "session string, after long, next long, enabled boolean, score double, source string, locked boolean, stable boolean")
    first = paragraphs.resolve_boundaries(auto, none)
    numbered = paragraphs.paragraph_numbers(turns, first)
    split = paragraphs.split_override(numbered, spark.createDataFrame([("s", 1, None), ("s", 1, 99)], "session string, paragraph long, after long"))
    assert [(r.after, r.next, r.enabled) for r in split.collect()] == [(2, 3, True)]
    again = paragraphs.resolve_boundaries(auto, split, final=True)
    numbered = paragraphs.paragraph_numbers(turns, again)
    assert [r.paragraph for r in numbered.orderBy("ordinal").collect()] == [1, 1, 1, 2, 2, 2]
    merge = paragraphs.merge_override(numbered, spark.createDataFrame([("s", 2), ("s", 1)], "session string, paragraph long"))
    assert [(r.after, r.next, r.enabled) for r in merge.collect()] == [(2, 3, False)]
    tomb = merge.withColumn("next", F.lit(77).cast("long"))
    assert paragraphs.resolve_boundaries(auto, tomb).where("next = 77").count() == 1


def test_retrieval_abstains_and_ranks(spark):
    items = spark.createDataFrame(
        [(0, "Bayes theorem and posterior probability", "0", 0), (1, "posterior probability of coins", "1", 0), (2, "the what and which", "2", 0), (3, "BAYES  theorem and posterior probability", "3", 0)],
        "item_id long, text string, label string, idx int",
    )
    items = retrieval.distinct_snippets(items)
    assert sorted(r.item_id for r in items.collect()) == [0, 1, 2]
    docs = spark.createDataFrame([(1, "what is which"), (2, "one theorem only"), (3, "the posterior probability by Bayes theorem")], "doc_id long, text string")
    got = retrieval.ranked_evidence(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.rank) for r in sorted(got, key=lambda r: (r.doc_id, r.rank))] == [(3, 0, 1), (3, 1, 2)]


def test_full_evidence(spark):
    items = spark.createDataFrame(
        [(0, "Bayes theorem relates beliefs", "M1:S1", "a.md"), (1, "light theorem of optics", "M1:S2", "a.md"), (2, "A CNN sees pixels", "M1:S3", "a.md"), (3, "cnn in small letters", "M1:S4", "a.md")],
        "item_id long, text string, label string, filename string",
    )
    docs = spark.createDataFrame([(1, "the base theorem"), (2, "our CNN today"), (3, "a right thing"), (4, "theorem")], "doc_id long, text string")
    generic = (*retrieval.GENERIC_WORDS, "right", "light", "today")
    ranked = retrieval.evidence(docs, items, generic=generic)
    assert {(r.doc_id, r.item_id, r.near, r.acronym) for r in ranked.collect()} == {(1, 0, 1, 0), (2, 2, 0, 1)}
    chosen = {r.doc_id: (r.item_ids, r.text) for r in retrieval.select_evidence(ranked, items).collect()}
    assert chosen[1] == ([0], "--- [M1:S1] a.md ---\nBayes theorem relates beliefs")
    assert retrieval.select_evidence(ranked, items, characters=10).first().item_ids == []


def test_greedy_budget_goes_on_after_a_large_one(spark):
    rows = spark.createDataFrame([([10, 95, 30, 40, 5],)], "n array<int>")
    taken = rows.select(retrieval.greedy_budget(F.col("n"), lambda e: e, F.lit(60), 3).alias("t")).first().t
    assert taken == [10, 30, 5]


def test_material_change_stops_at_manual_edits(spark):
    rows = [("s", k, "x", "manual-edit" if k == "notes" else "model", False) for k in ("rawTranscript", "cleanedTranscript", "notes", "notesTranslation", "outline", "outlineTranslation", "qa")]
    got = {r.key for r in lineage.material_change(spark.createDataFrame(rows, "session string, key string, content string, source string, stale boolean")).collect()}
    assert got == {"cleanedTranscript", "outline", "outlineTranslation", "qa"}


@pytest.mark.parametrize(("base", "edited", "current", "want"), [("a", "b", "a", "b"), ("a", "b", "ac", "bc"), ("a", "bc", "ac", "bc"), ("a", "b", "z", "b"), (None, "b", None, "b")])
def test_edit_merge(spark, base, edited, current, want):
    row = spark.createDataFrame([(base, edited, current)], "b string, e string, c string")
    assert row.select(lineage.merge_edit(F.col("b"), F.col("e"), F.col("c"))).first()[0] == want


def test_as_of(spark):
    left = spark.createDataFrame([(1, 1, 5), (2, 1, 1), (3, 2, 9)], "id int, k int, t int")
    right = spark.createDataFrame([(1, 2), (1, 5), (1, 6)], "k int, r int")
    assert sorted((r.id, r.matched) for r in profiler.as_of(left, right, "k", "t", "r").collect()) == [(1, 5), (2, None), (3, None)]


def test_model_plan(spark):
    have = spark.createDataFrame([("small",), ("large",), ("mine",)], "model string")
    assert segments.model_plan(have, "revised").first().fallbacks == ["large", "small"]
    assert segments.model_plan(have, "provisional", explicit="mine").first().model == "mine"
    assert segments.model_plan(have, "highQuality", legacy="mine").first().fallbacks == ["large", "small", "mine"] or segments.model_plan(have, "highQuality", legacy="mine").first().fallbacks[0] == "large"
    assert segments.model_plan(have.limit(0), "revised").first().model is None


def test_small_projections(spark):
    sessions = spark.createDataFrame([(1, " x ", "/p"), (2, None, "/q")], "session int, transcript string, stored_path string")
    got = segments.public_session(sessions)
    assert got.columns == ["session", "transcript", "has_transcript"] and [r.has_transcript for r in got.orderBy("session").collect()] == [True, False]
    groups = spark.createDataFrame([("s", 1, [0, 2, 9])], "session string, paragraph int, ordinals array<long>")
    assert segments.segment_texts(groups, spark.createDataFrame(seg(["a", "b", "c"]), SEG)).first().text == "a c"
    attempts = spark.createDataFrame([(1, [(2, 1), (1, 0)]), (2, None)], "session int, attempts array<struct<accepted:int,rejected:int>>")
    assert sorted(map(tuple, segments.repair_totals(attempts).collect())) == [(1, 3, 1, True), (2, 0, 0, False)]
    cases = spark.createDataFrame([("a", "r", "1"), ("b", "r", "1"), ("c", "r", "1"), ("d", "r", "1")], "case string, run_fp string, case_fp string")
    done = spark.createDataFrame([("a", "r", "1", "complete"), ("b", "r", "0", "complete"), ("c", "x", "1", "complete")], "case string, run_fp string, case_fp string, status string")
    assert {r["case"]: r.action for r in segments.resume_plan(cases, done).collect()} == {"a": "keep", "b": "rerun", "c": "refuse", "d": "start"}


def test_markdown():
    assert markdown.render("# A\n\nx **b** *i* `c<`\ny [M1:S2]\n> q") == "<h1>A</h1><p>x <strong>b</strong> <em>i</em> <code>c&lt;</code> y <sup>[M1:S2]</sup></p><blockquote>q</blockquote>"
    assert markdown.render("- a\n  - b\n- c\n1. d") == "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol><li>d</li></ol>"
    assert markdown.render(None) == ""


# Folds and streams --------------------------------------------------------------------------------


def test_segmenter_cuts():
    speech, quiet = (0.5, 100.0), (0.0, 100.0)
    got = list(folds.segment_frames([speech] * 6 + [quiet] * 7 + [speech] * 5))
    assert got == [(0.0, 1300.0, True, "speech-boundary"), (1300.0, 1800.0, True, "stop")]
    assert [g[3] for g in folds.segment_frames([speech] * 150)] == ["max-duration", "stop"]
    assert list(folds.segment_frames([quiet] * 3)) == [(0.0, 300.0, False, "stop")]


def test_auto_stop():
    noise = [(0.0, 0.5, 100.0), (100.0, 0.0, 100.0)]
    assert folds.auto_stop(noise) is None
    speech = [(100.0 * k, 0.5, 100.0) for k in range(5)]
    assert folds.auto_stop([*speech, (500.0, 0.0, 100.0)]) == 60_500.0
    assert folds.auto_stop([*speech, (500.0, 0.0, 100.0), (1000.0, 0.5, 100.0)]) is None


def test_scheduler_displaces_and_preempts():
    job = lambda key, priority, n, cost=10.0, soft=False: (float(n), folds.Job(key, priority, n, cost, soft))
    log = folds.replay([job("a", 3, 0, 100.0, True), job("b", 3, 1), job("b", 3, 2), job("c", 0, 3)], slots=1, capacity=2)
    assert (3.0, "a", "preempted") in log and (3.0, "c", "started") in log and (2.0, "b", "joined") in log
    log = folds.replay([job("x", 0, 0, 100.0), job("p", 3, 1), job("q", 3, 2), job("r", 3, 3), job("low", 9, 4)], slots=1, capacity=2)
    assert (3.0, "p", "displaced") in log and (4.0, "low", "refused") in log


def test_recycling():
    assert list(folds.recycle_epochs([(k * 10.0, k * 10.0 + 5) for k in range(30)]))[24:27] == [0, 1, 1]
    assert list(folds.recycle_epochs([(0.0, 5.0), (400_000.0, 400_005.0)])) == [0, 1]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{k % 2}", float(k), 0.5 if (k // 16) % 2 == 0 else 0.0, 100.0) for k in range(120)]
    ddl = "key string, at double, energy double, duration double"
    for n, part in enumerate((rows[:50], rows[50:90], rows[90:])):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = segmentation.segment_stream(stream).writeStream.format("memory").queryName("segments").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    closed = {tuple(r) for r in spark.table("segments").collect()}
    batch = {tuple(r) for r in segmentation.segment_batch(spark.createDataFrame(rows, ddl)).where("reason <> 'stop'").collect()}
    assert closed == batch and closed


# Files --------------------------------------------------------------------------------------------


def test_wav(spark):
    sound = files.encode_samples([0.0, 1.0, -1.0, 0.5])
    assert struct.unpack("<4h", sound) == (0, 32767, -32768, 16383)
    wav = files.wav_file(sound, 8000)
    head = files.read_wav_header(wav)
    assert head["valid"] and head["seconds"] == 4 / 8000
    odd = wav[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + wav[12:]
    assert files.read_wav_header(odd)["data_bytes"] == 8
    assert not files.read_wav_header(b"nope")["valid"]
    chunks = spark.createDataFrame([("r", 1, wav), ("r", 0, files.wav_file(sound[:4], 8000))], "recording string, sequence int, content binary")
    assert bytes(files.combine_wavs(chunks).first().content) == files.wav_file(sound[:4] + sound, 8000)


def test_materials(spark, tmp_path):
    pdf = b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (Hello \\(PDF\\) world) Tj T* [(and) -2 ( more\\041)] TJ ET") + b"\nendstream"
    deck = io.BytesIO()
    with zipfile.ZipFile(deck, "w") as z:
        for k in (10, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f"<a:p><a:t>Words of slide {k} here</a:t></a:p>")
    for name, data in (("a.pdf", pdf), ("b.pptx", deck.getvalue()), ("c.md", b"# plain *text* stays as it is"), ("d.html", b"<p>x &lt; y</p>"), ("e.exe", b"MZ")):
        (tmp_path / name).write_bytes(data)
    got = {r.path[-6:].split("/")[-1]: r for r in files.extract_materials(files.read_binary(spark, str(tmp_path))).collect()}
    assert got["a.pdf"].text == "Hello (PDF) world\nand more!" and got["a.pdf"].readable
    assert got["b.pptx"].text.split() == "## Slide 2 Words of slide 2 here ## Slide 10 Words of slide 10 here".split()
    assert got["c.md"].text == "# plain *text* stays as it is" and got["d.html"].text == "x < y"
    assert got["e.exe"].reader == "unsupported" and not got["e.exe"].readable
    manifest = spark.createDataFrame([(r.path, files.file_hash((tmp_path / r.path.rpartition("/")[2]).read_bytes())) for r in got.values()] + [("gone", "0")], "path string, sha256 string")
    status = {r.path: r.status for r in files.verified_manifest(manifest, files.read_binary(spark, str(tmp_path))).collect()}
    assert sorted(status.values()) == ["missing"] + ["verified"] * 5
    assert len(files.code_identity(files.read_binary(spark, str(tmp_path))).first().identity) == 64


def test_recognised_segments_in_milliseconds(spark):
    text = '{"transcription": [{"offsets": {"from": 1500, "to": 2500}, "tokens": [{"text": " he"}, {"text": "llo"}]}, {"text": " "}]}'
    rows = files.recognised_segments(spark.createDataFrame([(1, text), (2, "no json")], "id int, j string"), "id", "j").collect()
    assert [(r.idx, r.start, r.end, r.text) for r in rows] == [(0, 1.5, 2.5, "hello")]


# Registered queries -------------------------------------------------------------------------------

ORACLES = {k: v for k, v in __spark_entry__.oracle_sql().items() if not re.match(r"op\d+_", k) and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_like_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "item_id", "shared", "score", "rank"]


def test_tasks_of_a_retrieval_follow_the_number_of_queries(spark):
    """Before, terms were dealt to as many tasks as the session shuffles to, whatever the table; a task grew with it."""
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert retrieval.task_slots(spark.range(10)) == slots
    assert retrieval.task_slots(spark.range(retrieval.TASK_QUERIES * (slots + 3))) == slots + 3


def test_acronyms_are_whole_tokens(spark):
    docs = spark.createDataFrame([(1, "The GPU, a NLP2 and xABC"), (2, "GPUs ÉABC _CNN"), (3, None), (4, "(CNN)GPU")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "GPU"), (8, "ABC NLP"), (9, "CNN")], "item_id long, text string")
    assert sorted(map(tuple, retrieval.acronym_matches(docs, items, "doc_id").collect())) == [(1, 7), (4, 7), (4, 9)]
