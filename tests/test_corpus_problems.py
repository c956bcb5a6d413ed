"""Hierarchies and change capture against brute force and small cases."""

import random

import pytest

from kelpline.operators.change_capture import ChangeCapture, changes_by_run
from kelpline.operators.hierarchy import build_hierarchy, cycle_members, descendants

NODE = "id bigint, parent bigint, name string, path string"


def brute(rows):
    best = {}
    for i, p, n, _ in rows:
        if i is not None:
            key = (p is not None, p or 0, n or "")
            if i not in best or key < best[i][0]:
                best[i] = (key, p, n)
    parent = {i: v[1] if v[1] in best else None for i, v in best.items()}
    out = {}
    for i in parent:
        up, j = [], parent[i]
        while j is not None and j not in up and j != i:
            up.append(j)
            j = parent[j]
        if j is None:
            out[i] = ("tree", None, up[-1] if up else i, len(up), up[::-1])
        elif j == i:
            out[i] = ("cycle", min([i, *up]), None, None, None)
        else:
            ring = up[up.index(j) :]
            out[i] = ("below_cycle", min(ring), None, None, None)
    return out


def random_rows(seed, n):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *range(max(0, i - 6), i), *([i + 3] if r.random() < 0.05 else [])]), f"n{i}", "x") for i in range(n)]
    rows += rows[:5] + [(n, n, "self", None), (n + 1, n, "under", None), (n + 2, 10**9, None, None), (None, 1, "no", None)]
    return rows


@pytest.mark.parametrize("tail", [10**6, 20, 0])
def test_hierarchy_matches_brute_force(spark, tail):
    rows = random_rows(3, 60)
    got = build_hierarchy(spark.createDataFrame(rows, NODE), "id", "parent", "name", tail).collect()
    want = brute(rows)
    assert {r.node_id: (r.status, r.cycle_id, r.root_id, r.depth, r.ancestors) for r in got} == want
    assert len(got) == len(want)
    for r in got:
        if r.status == "tree":
            assert r.n_descendants == sum(1 for v in want.values() if v[4] and r.node_id in v[4])


@pytest.mark.parametrize("tail", [10**6, 0])
def test_cycles(spark, tail):
    rows = [(i, (i + 1) % 9, "c", None) for i in range(9)] + [(20, 3, "hang", None), (30, 31, "a", None), (31, 30, "b", None)]
    got = {(r.cycle_id, r.node_id) for r in cycle_members(spark.createDataFrame(rows, NODE), "id", "parent", "name", tail).collect()}
    assert got == {(0, i) for i in range(9)} | {(30, 30), (30, 31)}


def test_long_chains(spark):
    """A chain of 200,000 by the normal path: no cycle; a ring of as many: one. Paths of a chain of 3,000 are whole."""
    chain = spark.range(200_000).selectExpr("id", "if(id = 0, null, id - 1) as parent", "'c' as name")
    assert cycle_members(chain, "id", "parent", "name").count() == 0
    ring = spark.range(200_000).selectExpr("id", "(id + 1) % 200000 as parent", "'c' as name")
    got = cycle_members(ring, "id", "parent", "name").groupBy("cycle_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 200_000)]
    tree = build_hierarchy(chain.where("id < 3000"), "id", "parent", "name")
    last = tree.where("node_id = 2999").collect()[0]
    assert (last.depth, last.root_id, len(last.ancestors), len(last.path)) == (2999, 0, 2999, 5999)
    assert tree.selectExpr("sum(depth)").collect()[0][0] == 2999 * 3000 // 2


def test_descendants_and_labels(spark):
    rows = [(1, None, "a", None), (2, 1, None, None), (3, 2, "c", None), (4, 77, "", None)]
    tree = build_hierarchy(spark.createDataFrame(rows, NODE), "id", "parent", "name")
    assert {r.node_id: r.path for r in tree.collect()} == {1: "a", 2: "a/#2", 3: "a/#2/c", 4: "#4"}
    assert {tuple(r) for r in descendants(tree).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], NODE)
    assert build_hierarchy(empty, "id", "parent", "name").count() == 0
    feed, runs = spark.createDataFrame([], FEED), spark.createDataFrame([], RUNS)
    assert changes_by_run(feed, runs).count() == 0


FEED = "insert_id bigint, batch_no int, path string, hash string, modified_at bigint, run_id string"
RUNS = "run_id bigint, last_batch_no int, status string, path string"


def random_feed(seed):
    r = random.Random(seed)
    names = ["a/b.py", "./a/b.py", "a\\b.py", "a//b.py", "c.py", "a/./c.py", "d/../c.py"]
    return [(i, 1 + i // 12, r.choice([*names, None]), r.choice(["h1", "h2", "h3", None]), r.choice([1, 2, 3, 9, None]), "x") for i in range(96)]


def brute_changes(feed, runs):
    canon = {"./a/b.py": "a/b.py", "a\\b.py": "a/b.py", "a//b.py": "a/b.py", "a/./c.py": "a/c.py", "d/../c.py": "c.py"}
    out, before = set(), {}
    for run, last, status, _ in sorted(runs):
        if status != "succeeded":
            continue
        best = {}
        for i, b, p, h, m, _ in feed:
            if p is not None and b <= last:
                p = canon.get(p, p)
                best[p] = max(best.get(p, ((-1, -1), None)), ((-1 if m is None else m, i), h), key=lambda x: x[0])
        now = {p: v[1] for p, v in best.items()}
        out |= {(run, p) for p, h in now.items() if p not in before or before[p] != h}
        before = now
    return out


RUN_ROWS = [(1, 2, "succeeded", None), (2, 3, "failed", None), (3, 4, "succeeded", None), (4, 4, "succeeded", None), (5, 7, "succeeded", None), (6, 8, "running", None)]


def test_changes_by_run(spark):
    feed = random_feed(1)
    feed += feed[:10]
    got = [(r.run_id, r.path) for r in changes_by_run(spark.createDataFrame(feed, FEED), spark.createDataFrame(RUN_ROWS, RUNS)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_changes(feed, RUN_ROWS)


@pytest.mark.parametrize("fail_at", ["before_sink", "before_state", "before_commit"])
def test_capture_survives_failures(spark, tmp_path, fail_at):
    feed = random_feed(2)
    log = ChangeCapture(spark, str(tmp_path), partitions=4)
    rows = spark.createDataFrame(feed, FEED)
    with pytest.raises(RuntimeError):
        log.run(rows.where("batch_no <= 2"), 1, 2, fail_at=fail_at)
    for run, last, status, _ in RUN_ROWS:
        if status == "succeeded":
            log.run(rows, run, last)
    got = {(run, r.path) for run in log.committed() for r in log.changes(run).collect()}
    assert got == brute_changes(feed, RUN_ROWS)


def test_a_record_between_plan_and_replay_waits_for_the_next_run(spark, tmp_path):
    """The plan's offsets decide: a late record under an old batch number lies beyond the end of the open plan."""
    feed = [(1, 1, "a", "h1", 1, "x"), (2, 1, "b", "h1", 1, "x"), (3, 2, "a", "h2", 2, "x")]
    log = ChangeCapture(spark, str(tmp_path), partitions=4)
    with pytest.raises(RuntimeError):
        log.run(spark.createDataFrame(feed, FEED), 1, 2, fail_at="before_sink")
    late = [*feed, (9, 1, "b", "h9", 9, "x"), (10, 2, "c", "h1", 1, "x")]
    later = spark.createDataFrame(late, FEED)
    assert {(r.path, r.hash) for r in log.run(later, 2, 2).collect()} == {("b", "h9"), ("c", "h1")}
    assert {(r.path, r.hash) for r in log.changes(1).collect()} == {("a", "h2"), ("b", "h1")}
    assert log.run(later, 3, 2).count() == 0
    assert log.committed() == [1, 2, 3]


def test_offsets_decide_the_run_of_a_record(spark):
    """Batch numbers only bound what a run sees; a record inside a run's range is taken by that run."""
    feed = [(1, 1, "a", "h1", 1, "x"), (2, 2, "a", "h2", 2, "x"), (5, 1, "a", "h3", 3, "x"), (7, 4, "a", "h4", 4, "x")]
    runs = [(1, 1, "succeeded", None), (2, 2, "succeeded", None), (3, 4, "failed", None)]
    got = {(r.run_id, r.hash) for r in changes_by_run(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS), partitions=1).collect()}
    assert got == {(1, "h3")}


def test_offsets_that_fall_behind_the_batches(spark, tmp_path):
    """Copies of a feed with ids behind one another: later batches of one copy have lower ids than the first of the next."""
    feed = [(k * 1000 + i, b, f"{p[0]}{k}", h, m, x) for k in range(3) for i, b, p, h, m, x in random_feed(4) if p is not None]
    rows, runs = spark.createDataFrame(feed, FEED), spark.createDataFrame(RUN_ROWS, RUNS)
    want = brute_changes(feed, RUN_ROWS)
    for partitions in (1, 64):
        got = [(r.run_id, r.path) for r in changes_by_run(rows, runs, partitions).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    log = ChangeCapture(spark, str(tmp_path), partitions=2)
    for run, last, status, _ in RUN_ROWS:
        if status == "succeeded":
            log.run(rows, run, last)
    assert {(run, r.path) for run in log.committed() for r in log.changes(run).collect()} == want


def test_state_is_folded_after_some_runs(spark, tmp_path, monkeypatch):
    from kelpline.operators import change_capture

    monkeypatch.setattr(change_capture, "DELTAS", 2)
    log = ChangeCapture(spark, str(tmp_path), partitions=2)
    for k in range(1, 7):
        rows = [(i, b, f"p{b % 3}", f"h{b // 2}", b, "x") for i, b in enumerate(range(1, k + 1), 1)]
        log.run(spark.createDataFrame(rows, FEED), k, k)
    runs = [(k, k, "succeeded", None) for k in range(1, 7)]
    want = brute_changes(rows, runs)
    assert {(run, r.path) for run in log.committed() for r in log.changes(run).collect()} == want
    assert len(log.files.names("state/delta")) <= 2 and len(log.files.names("state/base")) == 1
