import threading

import pytest

from quillspark.sources.commits import CommittedTable, ConflictError

DDL = "id long, part string, value long, expected_fp string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), DDL)


@pytest.fixture
def table(spark, tmp_path):
    return CommittedTable(spark, f"file://{tmp_path}/table", ["id", "part"])


def known(table):
    return {(r.id, r.part): (r.value, r.row_fp) for r in table.read().collect()}


def test_versions_can_be_read_again_and_compacted(spark, table):
    assert table.current() == 0 and table.read() is None
    assert table.commit(rows(spark, (1, "a", 10, None), (2, "a", 20, None))) == 1
    fp = known(table)[1, "a"][1]
    assert table.commit(rows(spark, (1, "a", 11, fp), (3, "b", 30, None))) == 2
    want = {(1, "a"): 11, (2, "a"): 20, (3, "b"): 30}
    assert {k: v for k, (v, _) in known(table).items()} == want
    assert {(r.id, r.value) for r in table.read(1).collect()} == {(1, 10), (2, 20)}
    assert table.compact() == 3 and {k: v for k, (v, _) in known(table).items()} == want and len(table._layers(3)) == 1


def test_stale_writers_are_refused_and_leave_nothing(spark, table):
    table.commit(rows(spark, (1, "a", 10, None)))
    old = known(table)[1, "a"][1]
    table.commit(rows(spark, (1, "a", 11, old)))
    before = known(table)
    for stale in ((1, "a", 99, old), (1, "a", 99, None), (7, "a", 1, "never there")):
        with pytest.raises(ConflictError):
            table.commit(rows(spark, stale, (8, "new", 1, None)))
    assert known(table) == before and table.current() == 2
    for wrong in (((1, "x", 1, None), (1, "x", 2, None)), ((None, "x", 1, None),)):
        with pytest.raises(ValueError, match="one row for each key"):
            table.commit(rows(spark, *wrong))


def test_one_of_two_writers_gets_a_version(spark, table):
    table._publish(1, ["first"])
    won = []
    barrier = threading.Barrier(6)

    def write(k):
        barrier.wait()
        won.append(table._publish(2, [f"writer-{k}"]))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 5 + [True] and table.versions() == [1, 2] and len(table._layers(2)) == 1


def test_concurrent_writers_and_readers(spark, table):
    table.commit(rows(spark, *[(k, "sum", 0, None) for k in range(4)]))
    start = known(table)
    barrier, results, seen = threading.Barrier(3), {}, []

    def write(name, changes):
        batch = rows(spark, *changes)
        barrier.wait()
        try:
            results[name] = table.commit(batch)
        except ConflictError:
            results[name] = "refused"

    # Two change row 0 and so exclude each other; each also moves what it adds from another row, so sums stay 0.
    clash = [(0, "sum", 5, start[0, "sum"][1])]
    threads = [
        threading.Thread(target=write, args=("a", [*clash, (1, "sum", -5, start[1, "sum"][1])])),
        threading.Thread(target=write, args=("b", [*clash, (2, "sum", -5, start[2, "sum"][1])])),
        threading.Thread(target=write, args=("c", [(3, "sum", 7, start[3, "sum"][1]), (9, "sum", -7, None)])),
    ]
    [t.start() for t in threads]
    while any(t.is_alive() for t in threads):
        seen.append(sum(r.value for r in table.read().collect()))
    [t.join() for t in threads]
    assert sorted(map(str, (results["a"], results["b"])))[1] == "refused" and results["c"] != "refused"
    assert set(seen) <= {0} and sum(v for v, _ in known(table).values()) == 0 and table.current() == 3
