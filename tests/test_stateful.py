import datetime
import random

import pytest
from pyspark.sql.types import StructType

from quillspark.operators import units
from quillspark.streaming import stateful

START = datetime.datetime(2024, 1, 1)


def run_stream(spark, path, batches, ddl, build, name, restart_after=None):
    """The rows that a query sends for one file per micro-batch; it is stopped and started anew between two of them."""
    schema, out = StructType.fromDDL(ddl), f"{path}/{name}-out"

    def go(upto):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}-in/*")
        q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}-in/{n:03d}")
        if restart_after is not None and n in restart_after:
            go(n)
    go(len(batches))
    return [tuple(r) for r in spark.read.parquet(out).collect()]


TEXTS = {
    "a": 'First one. Second "quoted one." (Third?!) Second one… First one. And an open',
    "b": "no mark at all",
    "c": "... leading marks. Repeat. Repeat. Repeat",
    "d": "Done.",
    "e": "日本語。次の文！ 終わり",
    "f": "",
}


def cut(rng, text, most):
    places = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(rng.randint(0, most)))})
    return [text[i:j] for i, j in zip(places, places[1:], strict=False)] or [""]


@pytest.mark.parametrize("seed", range(60))
def test_assembly_equals_whole_text_over_any_cut(seed):
    rng = random.Random(seed)
    for text in TEXTS.values():
        whole = stateful.Assembly()
        whole.add(0, text, True)
        want = whole.advance()
        pieces = list(enumerate(cut(rng, text, 12)))
        order = [(k, t, k == len(pieces) - 1) for k, t in pieces]
        order += [rng.choice(order)]
        rng.shuffle(order)
        held, got = None, []
        for piece in order:  # state goes through its stored form each time
            own = stateful.Assembly(held)
            own.add(*piece)
            got += own.advance()
            held = own.held()
        assert [u[:3] + u[4:] for u in got] == [u[:3] + u[4:] for u in want], (text, order)


def test_stream_of_pieces_equals_the_batch_form_and_survives_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, k, t, k == len(p) - 1) for s, text in TEXTS.items() for p in [cut(rng, text, 8)] for k, t in enumerate(p)]
    rows += rng.sample(rows, 5)
    rng.shuffle(rows)
    batches = [rows[i::4] for i in range(4)]
    got = run_stream(spark, tmp_path, batches, "session string, seq long, text string, last boolean", stateful.assembled, "units", restart_after={0, 2})
    batch = units.assemble(spark.createDataFrame(list(TEXTS.items()), "session string, text string"), finalize=True).collect()
    assert sorted((s, o, t, k) for s, o, t, k, _, _ in got) == sorted((r.session, r.ordinal, r.text, r.key) for r in batch)
    assert len({(s, i) for s, _, _, _, i, _ in got}) == len(got)


def test_identities_are_those_of_the_versions_in_turn(spark):
    text = "One here. Two the"
    versions = [text, "One here. Two there. Thr", "One here. Two there. Three. One here."]
    own, got, before = stateful.Assembly(), [], ""
    previous = spark.createDataFrame([], "session string, ordinal int, key string, id string")
    for k, version in enumerate(versions):
        own.add(k, version[len(before) :], k == 2)
        got += own.advance()
        before = version
        now = units.assemble(spark.createDataFrame([("s", version)], "session string, text string"))
        ids = units.reuse_identities(now, previous)
        rows = now.select("session", "ordinal", "key").join(ids, ["session", "ordinal"]).select("session", "ordinal", "key", "id").collect()
        previous = spark.createDataFrame(rows, "session string, ordinal int, key string, id string")
    assert [(o, i) for o, _, _, i, _ in got] == sorted((r.ordinal, r.id) for r in previous.collect())


def timed(rows):
    return [(*r, START + datetime.timedelta(milliseconds=r[1])) for r in rows]


def replayed(rng, rows, n, late_ms):
    """Rows in batches, out of order within what may be late, some of them twice, and a last one that moves time on."""
    shuffled = sorted(rows + rng.sample(rows, len(rows) // 5), key=lambda r: r[1] + rng.random() * late_ms)
    size = -(-len(shuffled) // n)
    end = ("~end", max(r[1] for r in rows) + 100 * late_ms, 10**9, *[None] * (len(rows[0]) - 3))
    later = (end[0], end[1] + 1, end[2] + 1, *end[3:])
    return [timed(shuffled[i : i + size]) for i in range(0, len(shuffled), size)] + [timed([end]), timed([later])]


CASES = {
    "verdicts": (stateful.verdict_step, stateful.VERDICTS, "kind string, token string, revision long", lambda rng, k: (rng.choice(["state", "result", "result", "result"]), rng.choice(["t1", "t1", "t2"]), rng.randint(0, 4))),
    "claims": (stateful.claim_step, stateful.GRANTS, "kind string, revision long, language string", lambda rng, k: ("unit" if k % 17 == 0 else "claim", rng.randint(1, 2), rng.choice(["en", "fr"]))),
    "telemetry": (stateful.telemetry_step(8, 4, 3), stateful.TELEMETRY, "kind string, item long", lambda rng, k: (rng.choice(["start", "end"]), rng.randint(0, 6))),
}


@pytest.mark.parametrize("name", CASES)
def test_out_of_order_and_repeated_rows_give_the_batch_answer(spark, tmp_path, name):
    step, out, extra, make = CASES[name]
    rng = random.Random(len(name))
    rows = [(f"k{rng.randint(0, 3)}", k * 500 + rng.randint(0, 3) * 100, k, *make(rng, k)) for k in range(160)]
    ddl = f"key string, at long, id long, {extra}"
    offset = int(START.replace(tzinfo=datetime.UTC).timestamp() * 1000)
    moved = [(r[0], r[1] + offset, *r[2:]) for r in rows]
    batch = stateful.in_order_batch(spark.createDataFrame(moved, ddl), ["key"], step, out)
    batches = [[(r[0], r[1] + offset, *r[2:]) for r in part] for part in replayed(rng, rows, 5, 8_000)]
    got = run_stream(spark, tmp_path, batches, ddl + ", ts timestamp", lambda s: stateful.in_order(s, ["key"], "ts", step, out, late="10 seconds"), name, restart_after={1, 3})
    want = sorted(map(repr, map(tuple, batch.collect())))
    assert sorted(repr(r) for r in got if r[0] != "~end") == want and len(want) > 50


def test_telemetry_stays_within_its_bounds():
    held, step = {}, stateful.telemetry_step(5, 3, 2)
    for k in range(500):
        list(step(held, {"key": "a", "at": k, "id": k, "kind": "start" if k % 2 else "end", "item": k % 7}))
        assert len(held["log"]) <= 5 and len(held["samples"]) <= 3 and len(held["open"]) <= 2
