import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunks, guard, repair, sentences
from quillspark.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Smith met J. Doe. They spoke.", ["Dr. Smith met J. Doe.", "They spoke."]),
        ("Pi is 3.14 today. Yes!", ["Pi is 3.14 today.", "Yes!"]),
        ("Wait... what? Ok", ["Wait... what?", "Ok"]),
        ("Wait... What? Ok", ["Wait...", "What?", "Ok"]),
        ("See https://a.org/b.html now. Done", ["See https://a.org/b.html now.", "Done"]),
        ("It ended.Then more", ["It ended.", "Then more"]),
        ("e.g. this, i.e. that", ["e.g. this, i.e. that"]),
        ("你好。再见！", ["你好。", "再见！"]),
        ('He said "go." Then left', ['He said "go."', "Then left"]),
        ("a\nb\n\nc", ["a b", "c"]),
        ("", []),
        (None, []),
    ],
)
def test_sentences(text, want):
    assert sentences.split_sentences(text) == want


def test_sentence_paragraphs():
    assert sentences.sentence_paragraphs("One.  Two.\nThree.\n\n\nFour") == "One. Two. Three.\n\nFour"


def test_stable_sentences_and_tail(spark):
    assert one(spark, "One. Two! three", T.stable_sentences) == ["One.", "Two!"]
    assert one(spark, "One. Two! three", T.unfinished_tail) == "three"
    assert one(spark, 'He said "go." and then', T.unfinished_tail) == "and then"
    assert one(spark, "nothing yet", T.unfinished_tail) == "nothing yet"
    assert one(spark, None, T.stable_sentences) == []
    assert one(spark, "x" * 30000, T.stable_sentences) == []


@pytest.mark.parametrize(("word", "want"), [("models", "model"), ("class", "class"), ("basis", "basis"), ("running", "runn"), ("buildings", "build"), ("sing", "sing"), ("ties", "ties")])
def test_stem(spark, word, want):
    assert one(spark, word, T.stem) == want


def test_markup(spark):
    html = "<p>A&amp;B<br>c</p><h1>T</h1><w:br/>x<w:tab/>y &unknown; &LT;"
    assert one(spark, html, T.markup_to_text) == "A&B c\n T\n\nx\ty &unknown; <"


def test_content_measure(spark):
    assert one(spark, "two words", T.content_measure) == 2
    assert one(spark, "概率论的课程", T.content_measure) == 6
    assert one(spark, None, T.content_measure) == 0


@pytest.mark.parametrize(
    ("a", "b", "want"), [("cat", "cat", True), ("cats", "cat", False), ("models", "model", True), ("build", "building", True), ("bayes", "bases", True), ("bayes", "basis", False), ("abcd", "abcdefghijk", False)]
)
def test_equivalent_tokens(spark, a, b, want):
    assert guard.equivalent(a, b) is want
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.equivalent_token(F.col("a"), F.col("b"))).first()[0] is want


@pytest.mark.parametrize(
    ("text", "want"),
    [("two hundred and five", [205]), ("3.5 and twenty one", [3.5, 21]), ("five six", [11]), ("one thousand two", [1002]), ("hundred", []), ("two thousand and", [2000]), ("", [])],
)
def test_number_concepts(text, want):
    assert guard.number_concepts(text) == want


def test_artifacts():
    assert guard.remove_artifacts("[INAUDIBLE AUDIO] the model model , works\n\n[MUSIC]\nend .") == "[unclear] the model, works\n\nend."
    assert guard.remove_artifacts("café café, this this") == "café café, this"
    assert guard.remove_repeats("We go on. We go on. We go on. Stop.") == "We go on. Stop."


SOURCE = "The gradient of the loss function tells us how the parameters should change during training of the network."


@pytest.mark.parametrize(
    ("candidate", "reason"),
    [
        ("", "empty-output"),
        ("Sure, " + SOURCE, "model-commentary"),
        ('{"content": "x"}', "malformed-output"),
        ("概率论的课程内容是关于随机变量的", "unexpected-translation"),
        (SOURCE + " " + " ".join(f"extra{i}" for i in range(80)), "large-expansion"),
        ("The gradient.", "large-deletion"),
        (SOURCE.replace("network", "zebra"), "unsupported-terms"),
        (SOURCE + " It is done. It is done.", "duplicated-output"),
        (SOURCE + " There are 42.", "unsupported-number"),
    ],
)
def test_guard_reasons(candidate, reason):
    assert reason in guard.check(SOURCE, candidate)["reasons"]


def test_guard_accepts_and_drafts():
    good = SOURCE.replace("tells us", "tells")
    assert guard.check(SOURCE, good)["ok"]
    assert guard.choose_draft(SOURCE, ["", good]) == {"text": good, "attempt": 2, "fallback": False}
    assert guard.choose_draft(SOURCE, ["Sure, " + SOURCE, good])["fallback"]
    assert guard.check("We use 3 layers.", "We use layers.")["reasons"] == ["missing-numeric-detail"]
    assert "context-leakage" in guard.check(SOURCE, SOURCE + " " + "before text " * 6, before="before text " * 6)["reasons"]


def test_edit_distance():
    assert [guard.edit_distance(a, b) for a, b in (("", ""), ("a", ""), ("kitten", "sitting"), ("flaw", "lawn"))] == [0, 1, 3, 2]


EVIDENCE = {"M1:S1": "Bayes theorem relates conditional probability and prior belief. The Kalman filter estimates hidden states of linear systems."}


def test_repair_candidates_and_application():
    source = "Today base theorem relates conditional probability and prior belief."
    offered = repair.candidates(source, EVIDENCE)
    assert [(p["edit"].original, p["edit"].replacement) for p in offered if p["edit"].replacement == "Bayes"] == [("base", "Bayes")] or offered == []
    edit = repair.Edit("Kalmen", "Kalman", "term", "M1:S1", EVIDENCE["M1:S1"][:120])
    text = "The Kalmen filter estimates hidden states."
    assert repair.refuse(text, edit, EVIDENCE) is None
    done = repair.apply(text, [edit, edit], EVIDENCE)
    assert done["text"] == "The Kalman filter estimates hidden states." and done["rejected"][0][1] == "overlapping-edit"


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"kind": "other"}, "invalid-edit-kind"), ({"original": ""}, "missing-edit-field"), ({"replacement": "a; b"}, "sentence-rewrite"), ({"evidence_id": "X"}, "invalid-evidence-id"),
        ({"original": "nowhere"}, "source-span-not-found"), ({"original": "Kalm"}, "partial-word-edit"), ({"replacement": "kalmen"}, "style-only-edit"), ({"occurrence": 4}, "invalid-source-occurrence"),
        ({"quote": "short"}, "invalid-evidence-quote"), ({"replacement": "Kolman"}, "replacement-not-in-evidence"), ({"replacement": "x" * 97}, "edit-too-large"),
        ({"original": "[unclear]"}, "uncertainty-must-be-preserved"),
    ],
)
def test_refusals(change, reason):
    base = {"original": "Kalmen", "replacement": "Kalman", "kind": "term", "evidence_id": "M1:S1", "quote": EVIDENCE["M1:S1"][:120], "occurrence": None}
    assert repair.refuse("The Kalmen filter estimates hidden states.", repair.Edit(**(base | change)), EVIDENCE) == reason


def test_selection_conflicts():
    a = repair.Edit("Kalmen", "Kalman", "term", "M1:S1", EVIDENCE["M1:S1"][:120])
    b = repair.Edit("Kalmen", "filter", "term", "M1:S1", EVIDENCE["M1:S1"][:120])
    offered = [{"id": "C1", "edit": a, "start": 4, "stop": 10}, {"id": "C2", "edit": b, "start": 4, "stop": 10}]
    text = "The Kalmen filter estimates hidden states."
    done = repair.apply_selection(text, ["C1", "C2", "C9"], offered, EVIDENCE)
    assert done["text"] == text and sorted(r for _, r in done["rejected"]) == ["conflicting-candidate-selection", "conflicting-candidate-selection", "invalid-candidate-id"]
    assert repair.apply_selection(text, ["C1"], offered, EVIDENCE)["text"].startswith("The Kalman")


@pytest.mark.parametrize("limit", [40, 77, 500])
def test_chunks_are_bounded_and_whole(limit):
    text = "First sentence here. Second one is a bit longer, truly. " * 20 + "x" * 300 + "\n\nLast 句子。"
    parts = chunks.lossless_windows(text, limit)
    assert "".join(parts) == text and all(0 < len(p) <= limit for p in parts)
    pieces = chunks.split_oversized(text, limit)
    assert all(len(p) <= limit for p in pieces) and "".join("".join(pieces).split()) == "".join(text.split())
    packed = chunks.windows(chunks.source_paragraphs(text, limit=200), limit)
    assert all(len(w["text"]) <= max(40, limit) for w in packed)
    assert [w["continues_previous"] for w in packed[1:]] == [w["continues_next"] for w in packed[:-1]]
    assert all(len(c) <= limit for c in chunks.semantic_chunks(text, limit))


def test_snippets_drop_oversized_sentences():
    assert chunks.snippets("# A\nshort block\n\n" + "y" * 50, 30) == ["# A\nshort block"]
    assert chunks.snippets("One two three. Four five six. Seven.", 16) == ["One two three.", "Four five six.", "Seven."]


def test_display_groups():
    units = [("a", "one " * 10), ("b", "two " * 10), ("c", "three " * 30), ("d", "x"), ("e", "y"), ("f", "z"), ("g", "w")]
    assert chunks.display_groups(units) == [["a", "b"], ["c", "d", "e"], ["f", "g"]]
    assert chunks.display_groups([("a", "x"), ("b", "y")], {"a": 1, "b": 2}) == [["a"], ["b"]]


def test_malformed_output_is_told_by_lower_case_keys():
    for start, refused in (('{"content": "x', True), ('{"Content": "x', False)):
        assert ("malformed-output" in guard.check(SOURCE, start + SOURCE)["reasons"]) is refused


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance_equals_the_whole_table():
    rng = random.Random(9)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.choice([0, 1, 5, 40, 63, 64, 65, 130]))] for _ in range(2))
        assert guard.edit_distance(a, b) == plain_distance(a, b), (a, b)
    assert guard.edit_distance("日本語x", "本語xy") == 2


def test_edit_distance_of_long_texts_takes_little_memory():
    rng = random.Random(10)
    a = [f"w{rng.randint(0, 3000)}" for _ in range(20_000)]
    b = [w for w in a if rng.random() > 0.05]
    tracemalloc.start()
    began = time.time()
    assert guard.edit_distance(a, b) == len(a) - len(b)
    assert time.time() - began < 20 and tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()


def test_sentences_and_tails_of_odd_texts_and_the_price_of_a_tail(spark):
    """Random mixes of marks, closers, spaces and wide characters against plain Python; the end of a text is looked for from its end."""
    import re

    rng = random.Random(4)
    odd = ["", "...", "a", "a.\x85", "。x", 'a."! b', " a. b", "𝒳𝒴. 𝒵", "x\x00.y﻿"] + ["".join(rng.choice("ab .!?。！？…\"'”’»)\n\x00𝒳中\x85") for _ in range(rng.randrange(30))) for _ in range(400)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, text string")
    got = rows.select("i", T.normalise_space(F.col("text")).alias("n"), T.stable_sentences(F.col("text")).alias("s"), T.unfinished_tail(F.col("text")).alias("t")).collect()
    space, marks = re.compile(T.SPACE.replace("\\t", "\t").replace("\\r", "\r") + "+"), ".!?。！？…"
    clean = lambda x: space.sub(" ", x).strip(" ")
    for r in got:
        assert r.s == [y for y in (clean(x) for x in re.findall(rf"[^{marks}]+[{marks}]+[\"'”’»)]*", r.n)) if y]
        rest = re.sub("^[\"'”’»)]*", "", re.search(f"[^{marks}]*\\Z", r.n)[0])
        assert r.t == clean(rest if re.search(f"[^{marks}][{marks}]", r.n) else r.n)
    long = spark.createDataFrame([("Some words – “and more” – that end. 更多的话。 " * 100_000,)], "n string").repartition(1).persist()

    def seconds(column) -> float:
        each = []
        for _ in range(3):
            start = time.perf_counter()
            long.select(F.length(column)).collect()
            each.append(time.perf_counter() - start)
        return min(each)

    plain = seconds(F.col("n"))
    before = seconds(F.regexp_extract("n", r"(?<![^.!?。！？…])[^.!?。！？…]*+$", 0)) - plain
    assert seconds(F.regexp_replace("n", r"(?s)\A.*[.!?。！？…]", "")) - plain < 0.5 * before
    assert seconds(T.unfinished_tail(F.col("n"))) - seconds(T.normalise_space(F.col("n"))) < before


def test_a_python_worker_gets_batches_of_bounded_bytes(spark):
    """4,000 texts of 10,000 characters came as one batch of 40 MB."""
    from quillspark.functions.arrow import BATCH_BYTES, arrow_function

    @arrow_function("int")
    def together(text):
        return text.map(lambda _: len(text))

    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    assert rows.select(together(F.col("text")).alias("n")).agg(F.max("n")).first()[0] <= 2 * BATCH_BYTES // 10_000


def test_a_rewriting_is_compared_without_trying_every_pair_of_tokens(monkeypatch):
    """Two texts of 2,000 different words: before, 12,000,000 comparisons were made, now those with an end in common."""
    rng, calls, plain = random.Random(3), [], guard._one_edit
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4000)]
    monkeypatch.setattr(guard, "_one_edit", lambda a, b: calls.append(1) or plain(a, b))
    guard.check(" ".join(words[:2000]), " ".join(words[2000:]))
    assert len(calls) < 100_000


def test_vocabulary_finds_what_comparing_every_item_finds():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abs", k=rng.randint(1, 11)))
    for _ in range(300):
        items = [word() for _ in range(5)]
        known = guard.Vocabulary(items)
        for t in [word() for _ in range(10)] + [x + "s" for x in items] + [x[1:] for x in items if x[1:]] + [x[:2] + "b" + x[3:] for x in items]:
            assert (t in known) == any(guard.equivalent(t, x) for x in items)


def test_repeats_are_looked_for_only_where_there_may_be_some(monkeypatch):
    """Before, each text was searched for repeated sentences of any length at every space."""
    pattern = type("Never", (), {"sub": lambda *_: pytest.fail("searched"), "search": lambda *_: pytest.fail("searched")})()
    found = guard._SENTENCE_TWICE
    rng = random.Random(2)
    for _ in range(2000):
        text = " ".join(rng.choice(["One two.", "one two.", "Été!", "été!", "a.", "  .", "ſo.", "So.", "x", "\n"]) for _ in range(6))
        assert guard.may_repeat(text) or not found.search(text)
    monkeypatch.setattr(guard, "_SENTENCE_TWICE", pattern)
    assert guard.remove_repeats("One here. Two there. Three of them.") == "One here. Two there. Three of them."


def test_coverage_of_long_texts_does_not_try_every_pair(spark):
    """6,000 different tokens against as many others: before, 36 million pairs were compared in one row."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(12_000)]
    rows = spark.createDataFrame([(" ".join(words[:6000] + ["Kalman", "filters"]), " ".join(words[6000:] + ["kalmans", "filter"]))], "a string, b string")
    began = time.perf_counter()
    assert rows.select(T.token_coverage(F.col("a"), F.col("b"))).first()[0] == 2 / 6002
    assert time.perf_counter() - began < 20
