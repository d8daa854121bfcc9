import datetime as dt

import pytest

from codelode.operators.change_capture import ChangeFeed, next_state, pending_commits

LOG = "id bigint, root_id string, sha string, commit_date timestamp, subject string, body string"
T = dt.datetime(2024, 1, 1)


def _log(spark, rows):
    return spark.createDataFrame([(i, r, s, T, a, b) for i, r, s, a, b in rows], LOG)


def _runs(spark, rows):
    g = spark.createDataFrame([(g, r, T + dt.timedelta(days=d), c) for g, r, d, c, _, _ in rows], "generation_id string, root_id string, created_at timestamp, semantic_checksum string")
    h = spark.createDataFrame([(r, g, hd, 0, u, T) for g, r, _, _, hd, u in rows], "root_id string, generation_id string, head string, shallow int, unavailable string, recorded_at timestamp")
    return g, h


def test_pending(spark, tmp_path):
    log = _log(spark, [
        (1, "r", "a", "x", None), (2, "r", "b", "x", ""), (3, "r", "c", "x", ""), (4, "r", "a", "x", None), (5, "r", "b", "y", ""), (5, "r", "b", "y", ""),
        (1, "q", "a", "x", ""), (None, "q", "z", "x", ""), (2, None, "z", "x", ""), (3, "q", None, "x", ""),
        (1, "gone", "a", "x", ""),
    ])
    g, h = _runs(spark, [("g1", "r", 1, "ok", "b", None), ("g2", "r", 2, None, "c", None), ("g3", "r", 3, "ok", "c", "lost"), ("g4", "gone", 1, "ok", "nosuch", None)])
    got = {(r.root_id, r.sha) for r in pending_commits(log, g, h, str(tmp_path / "a")).collect()}
    # c is new, b amended; a came again unchanged; without a run, or with a lost head, all is pending
    assert got == {("r", "c"), ("r", "b"), ("q", "a"), ("gone", "a")}
    state = {r.root_id: (r.done_to, r.next_to, r.head, r.pending) for r in next_state(log, g, h, str(tmp_path / "b")).collect()}
    assert state["r"] == (2, 5, "b", 2) and state["q"] == (None, 1, "a", 1)


def test_empty(spark, tmp_path):
    log = _log(spark, [])
    g, h = _runs(spark, [])
    assert pending_commits(log, g, h, str(tmp_path / "a")).count() == 0 and next_state(log, g, h, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("where", ["plan", "sink"])
def test_feed_survives_failure(spark, tmp_path, where):
    feed = ChangeFeed(spark, str(tmp_path), "root_id", "sha", "id")
    one = _log(spark, [(1, "r", "a", "x", ""), (2, "r", "b", "x", ""), (1, "q", "a", "x", "")])
    assert feed.run(one) == 0
    two = one.unionByName(_log(spark, [(3, "r", "a", "new", ""), (3, "r", "a", "new", ""), (4, "r", "c", "x", "")]))
    with pytest.raises(RuntimeError):
        feed.run(two, fail_after=where)
    three = two.unionByName(_log(spark, [(5, "r", "d", "x", "")]))
    assert feed.run(three) == 1  # replays the planned range, without row 5
    assert {(r.root_id, r.sha, r.id) for r in feed.result().collect()} == {("r", "a", 3), ("r", "b", 2), ("r", "c", 4), ("q", "a", 1)}
    assert feed.run(three) == 2 and feed.run(three) is None
    assert feed.result().count() == 5


def test_unchanged_redelivery_is_no_work(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path), "root_id", "sha", "id", ("subject", "body"))
    one = _log(spark, [(1, "r", "a", "x", None), (2, "r", "b", "x", "")])
    assert feed.run(one) == 0
    two = one.unionByName(_log(spark, [(3, "r", "a", "x", None), (4, "r", "b", "y", ""), (5, "r", "c", None, None)]))
    assert feed.run(two) == 1
    assert {(r.sha, r.id) for r in feed.batch(two, 1).collect()} == {("b", 4), ("c", 5)}
    assert {(r.sha, r.id) for r in feed.result().collect()} == {("a", 1), ("b", 4), ("c", 5)}


def test_late_rows_stop_the_run(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path), "root_id", "sha", "id")
    one = _log(spark, [(1, "r", "a", "x", ""), (5, "r", "b", "x", "")])
    assert feed.run(one) == 0
    with pytest.raises(RuntimeError, match="late"):
        feed.run(one.unionByName(_log(spark, [(3, "r", "c", "x", ""), (6, "r", "d", "x", "")])))
    assert feed.run(one.unionByName(_log(spark, [(6, "r", "d", "x", "")]))) == 1


def test_compaction_keeps_the_result(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path), "root_id", "sha", "id")
    log = _log(spark, [(1, "r", "a", "x", "")])
    assert feed.compact() is None and feed.run(log) == 0
    for n in range(1, 4):
        log = log.unionByName(_log(spark, [(n + 1, "r", "abc"[n % 3], f"v{n}", "")]))
        assert feed.run(log) == n
    before = {tuple(r) for r in feed.result().collect()}
    assert feed.compact() == 3 and feed._whole("sink") == [] and feed._whole("plan") == [3] and feed._whole("base") == [3]
    assert {tuple(r) for r in feed.result().collect()} == before and feed.run(log) is None
    log = log.unionByName(_log(spark, [(9, "r", "z", "new", "")]))
    assert feed.run(log) == 4 and feed.result().count() == len(before) + 1
    assert feed.compact() == 4 and feed.result().count() == len(before) + 1
