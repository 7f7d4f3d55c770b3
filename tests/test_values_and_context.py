import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import alignment, repair
from quillspark.functions import values as V
from quillspark.operators import context, repairs, retrieval, rollups, segments
from quillspark.session import NotFoundError, checkpoint_dir, find_one, read_state
from quillspark.streaming import folds, segmentation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# Values -------------------------------------------------------------------------------------------


def test_resampling_and_mixing(spark):
    mono = V.mono_mix(F.array(F.array(F.lit(-1.0), F.lit(0.5), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(-1.0))))
    assert one(spark, mono) == [0.0, 0.25, 0.0]
    samples = F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 0.5)])
    assert one(spark, V.resample(samples, 32_000, 16_000)) == [0.0, 1.0]
    assert one(spark, V.resample(samples, 16_000)) == [0.0, 0.5, 1.0, 0.5]
    assert one(spark, V.resample(F.array().cast("array<double>"), 48_000)) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("Thanks for watching.", True), (" thank you  for watching!? ", True), ("Thanks for watching", True), ("Thanks for watching this lecture", False), ("", False), (None, False)],
)
def test_captions_out_of_silence(spark, text, want):
    assert one(spark, V.is_stock_caption(F.lit(text).cast("string"))) is want


@pytest.mark.parametrize(("x", "want"), [("2024-02-29", True), ("2023-02-29", False), ("2024-2-9", False), ("2024-02-30", False), ("", False), (None, False), ("2024-01-01\n", False)])
def test_calendar_dates(spark, x, want):
    assert one(spark, V.is_calendar_date(F.lit(x).cast("string"))) is want


def test_paths(spark):
    cases = {("/w/s", "a"): True, ("/w/s", "../s/b"): True, ("/w/s", "../t"): False, ("/w/s", "/w/s2"): False, ("/w/s", "."): True, ("/", "/x"): True, ("/w/s", "/"): False}
    for (root, target), want in cases.items():
        assert one(spark, V.is_contained(F.lit(root), F.lit(target))) is want, (root, target)
    assert one(spark, V.may_copy(F.lit("/a"), F.lit("/b"))) and one(spark, V.may_copy(F.lit("/a"), F.lit("/a")))
    assert not one(spark, V.may_copy(F.lit("/a"), F.lit("/a/b"))) and not one(spark, V.may_copy(F.lit("/a/b"), F.lit("/a")))


def test_numbers(spark):
    assert [one(spark, V.round_half_up(F.lit(x), 1)) for x in (0.25, -0.25, 1.0)] == [0.3, -0.2, 1.0]
    assert one(spark, V.numeric_option(F.lit("x"), 7, 1)) == 7 and one(spark, V.numeric_option(F.lit("-3"), 7, 1)) == 1 and one(spark, V.numeric_option(F.lit("900"), 7, 1, 256)) == 256
    assert one(spark, V.edit_distance(F.lit("kitten"), F.lit("sitting"))) == 3 and one(spark, V.edit_distance(F.lit("kitten"), F.lit("sitting"), 2)) is None


# Titles and roll-ups ------------------------------------------------------------------------------


def test_titles_are_numbered_beyond_deleted_ones(spark):
    day = "2024-05-01"
    sessions = spark.createDataFrame(
        [("Lecture — 1 May", day, None, None), ("Lecture — 1 May — 4", "2024-05-09", None, None), ("Other — 1 May — 9", day, None, None), ("x", day, day, 2)],
        "title string, created string, title_date string, title_index long",
    )
    requests = spark.createDataFrame([(1, day, "1 May"), (2, day, "1 May"), (3, "2024-05-02", "2 May")], "id int, date string, label string")
    counters = spark.createDataFrame([("2024-05-02", 11)], "date string, high long")
    got = {r.id: r.title for r in rollups.numbered_titles(requests, sessions, counters, "id").collect()}
    assert got == {1: "Lecture — 1 May — 5", 2: "Lecture — 1 May — 6", 3: "Lecture — 2 May — 12"}
    none = rollups.numbered_titles(requests, sessions.limit(0), counters.limit(0), "id").orderBy("id").collect()
    assert [r["index"] for r in none] == [1, 2, 1]


def test_coalesced_requests():
    assert list(folds.coalesce_requests([0.0, 1.0, 2.0, 50.0], 10.0)) == [(0.0, 10.0, 1), (10.0, 20.0, 2), (50.0, 60.0, 1)]
    assert list(folds.coalesce_requests([0.0, 5.0, 12.0], 10.0)) == [(0.0, 10.0, 1), (10.0, 20.0, 1), (20.0, 30.0, 1)]
    assert list(folds.coalesce_requests([], 1.0)) == []


def test_frame_batches_keep_what_a_flush_ends(spark):
    rows = [("a", 0, [1.0, 2.0, 3.0], False), ("a", 1, [4.0, 5.0], True), ("a", 2, [9.0], False), ("b", 0, [1.0, 2.0, 3.0], False)]
    got = {(r.key, r.batch): r.samples for r in rollups.frame_batches(spark.createDataFrame(rows, "key string, at int, samples array<double>, flush boolean"), 2).collect()}
    assert got == {("a", 0): [1.0, 2.0], ("a", 1): [3.0, 4.0], ("a", 2): [5.0], ("b", 0): [1.0, 2.0]}


def test_first_rows_and_budgets(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), ("a", 3, None)], "k string, t int, v string")
    assert sorted(map(str, segments.idempotent_ingest(rows, ["k"], "t").collect())) == ["Row(k='a', t=1, v='y')", "Row(k=None, t=5, v='z')"]
    texts = spark.createDataFrame([("g", k, "ab" * 3) for k in range(0, 40_000, 5_000)] + [("g", 1, None)], "g string, k long, t string")
    got = [(r.k, r.kept) for r in retrieval.truncating_budget(texts, "g", "k", "t", 15).orderBy("k").collect()]
    assert got == [(0, "ababab"), (5_000, "ababab"), (10_000, "aba")]


def test_lookups_and_state(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    assert find_one(rows, "id", "a").n == 1
    with pytest.raises(NotFoundError):
        find_one(rows, "id", "b")
    with pytest.raises(ValueError):
        find_one(rows, "id", " ")
    (tmp_path / "s.json").write_text('{"dates": {"x": 2}}')
    (tmp_path / "bad.json").write_text("[1")
    assert read_state(spark, f"file://{tmp_path}/s.json") == {"dates": {"x": 2}}
    assert read_state(spark, f"file://{tmp_path}/none.json", {"a": 1}) == {"a": 1} == read_state(spark, f"file://{tmp_path}/bad.json", {"a": 1})


def test_a_cluster_needs_a_shared_folder(spark):
    class Empty:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(Empty)})

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session)


# Context and alignment ----------------------------------------------------------------------------


def score(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(context.features(F.col("a")).alias("a"), context.features(F.col("b")).alias("b"))
    return row.select(context.similarity(F.col("a"), F.col("b")).alias("x")).first().x


def test_similarity_points(spark):
    assert score(spark, "gradient descent", "the gradient of descent") == 8
    assert score(spark, "cost grad", "cost of a grad") == 4
    assert score(spark, "bayesian", "bayesien rule") == 1
    assert score(spark, "chapter twelve", "page 12 then") == 4
    assert score(spark, "sigma λ = 3 now", "here λ = 4 too") == 3 + 2
    assert score(spark, "the of", "gradient") == 0 and score(spark, None, "x") == 0


def test_references_fill_a_budget(spark):
    paragraphs = spark.createDataFrame([("s", k, t) for k, t in enumerate(["gradient descent here", "gradient is near", "nothing at all", "gradient descent again and again", "target gradient descent"])], "session string, ordinal int, text string")
    windows = spark.createDataFrame([("s", 0, 4, 4, "target gradient descent", "so: gradient is near.")], "session string, window int, first int, last int, text string, adjacent string")
    got = context.lecture_reference(windows, paragraphs, 30).first()
    assert (got.n_paragraphs, got.reference) == (2, "gradient descent here\n\ngradien")
    assert context.lecture_reference(windows, paragraphs.limit(0)).collect() == []


def test_alignment_follows_the_canonical_text():
    canonical = "Canonical sentence one. Canonical sentence two."
    apart = alignment.align([{"start": 0.0, "end": 1.0, "text": "Different provider wording."}], canonical)
    assert " ".join(x["text"] for x in apart) == canonical and [x["id"] for x in apart] == ["seg_0", "seg_1"]
    content = "Dr. Smith explains the value 3.14. Next point follows."
    whole = alignment.align([{"id": "p", "start": 0.0, "end": 3.0, "text": content}], content)
    assert [x["text"] for x in whole] == ["Dr. Smith explains the value 3.14.", "Next point follows."]
    assert whole[0]["start"] == 0 and whole[-1]["end"] == 3.0 and whole[0]["source_id"] == "p" and [x["source_index"] for x in whole] == [0, 1]
    folded = alignment.align([{"id": "a", "text": "hello THERE."}, {"id": "b", "text": "and bye."}], "Hello there.  And bye.")
    assert [(x["id"], x["text"]) for x in folded] == [("a", "Hello there."), ("b", "And bye.")]
    assert alignment.align(None, None) == [] and [x["text"] for x in alignment.align([], "One. Two.")] == ["One.", "Two."]


def test_aligned_segments(spark):
    sessions = spark.createDataFrame([("s", "One thing. Two things."), ("t", None)], "session string, content string")
    parts = spark.createDataFrame([("s", 0, "a", "one thing.", 0.0, 1.0), ("s", 1, "b", "Two things.", 1.0, 2.0)], "session string, ordinal int, id string, text string, start double, end double")
    got = alignment.aligned_segments(sessions, parts).collect()
    assert sorted((r.session, r.place, r.id, r.text, r.start) for r in got) == [("s", 0, "a", "One thing.", 0.0), ("s", 1, "b", "Two things.", 1.0)]


def test_informative_words_are_told_by_the_fixed_list():
    assert repair.informative("These 2024 models improve the GRADIENT through lectures") == ["models", "improve", "gradient", "lectures"]


def test_repairs_come_from_each_texts_own_evidence(spark):
    right = "We combine the prior with evidence through the Bayes theorem for posterior estimates."
    sources = spark.createDataFrame([(1, "Then we use the Base theorem for posterior estimates with a prior."), (2, "Then we use the Base theorem for posterior estimates with a prior."), (3, None)], "key long, text string")
    items = spark.createDataFrame([(0, right), (1, "Nothing of that kind stands here at all."), (2, right)], "item_id long, text string")
    ranked = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 1, 1), (2, 2, 4), (3, 0, 1)], "key long, item_id long, rank int")
    got = repairs.repair_candidates(sources, ranked, items, "key").collect()
    plain = repair.candidates("Then we use the Base theorem for posterior estimates with a prior.", {"M1:S1": right, "M2:S1": "Nothing of that kind stands here at all."})
    assert [(r.key, r.start, r.replacement, r.evidence_id) for r in got] == [(1, p["start"], p["edit"].replacement, "M1:S1") for p in plain]


# Streaming ----------------------------------------------------------------------------------------


def test_stream_flushes_its_tail_when_a_key_goes_quiet(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"k{k % 2}", float(k), 0.5 if (k // 16) % 2 == 0 else 0.0, 100.0, start + datetime.timedelta(seconds=k / 10)) for k in range(118)]
    ddl = "key string, at double, energy double, duration double, ts timestamp"
    for n, part in enumerate((rows[:50], rows[50:], [("z", 0.0, 0.0, 100.0, start + datetime.timedelta(hours=1))], [("z", 1.0, 0.0, 100.0, start + datetime.timedelta(hours=2))])):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")
    run = segmentation.segment_stream(stream, "ts", idle_ms=60_000).writeStream.format("memory").queryName("tails").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    got = {tuple(r) for r in spark.table("tails").where("key <> 'z'").collect()}
    want = {tuple(r) for r in segmentation.segment_batch(spark.createDataFrame(rows, ddl).drop("ts")).collect()}
    assert got == want and any(r[-1] == "stop" for r in got)


# The same functions in the JVM and in Arrow batches -------------------------------------------------


def test_both_forms_of_text_functions_agree(spark):
    import random

    from quillspark.functions import guard
    from quillspark.functions import text as T

    rng = random.Random(17)
    parts = ["Bayes", "bayes'", "theorems", "theorem", "uh", "Um,", "漢字", "3.5", "x_y", "λ = 4", "2 × 3", "7 + 8 = 15", " ", "﻿", " ", "\n\n", "\x1c", "é", "naïve", "twelve", "models", "modelling", "a", "."]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(300)] + [(900, None, "x"), (901, "", None)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("k", T.normalise_space(a), T.tokens(a), T.meaningful_tokens(a), T.formulas(a), F.round(T.script_ratio(a), 9), F.round(T.token_coverage(a, b), 9)).collect()
    texts = {k: (x, y) for k, x, y in rows}
    for r in got:
        x, y = texts[r[0]]
        want = guard.meaningful(x)
        covered = guard.coverage(want, guard.Vocabulary(guard.meaningful(y)), False)
        assert tuple(r)[1:] == (guard.squeeze(x), guard.tokens(x), want, guard.formulas(x), round(guard.script_ratio(x or ""), 9), round(covered, 9)), x
