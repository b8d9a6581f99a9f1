"""Keyed state that ends: batches by timers, runs, hand-off and rollups over streams that come in several deliveries."""

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cueloom import constants as K
from cueloom.operators import jobs as jb
from cueloom.streaming import live as lv
from cueloom.streaming.stateful import CHANGE, cut_batches

SHAPE = "event_id long, ts timestamp, task_id string, step int, kind string, ok boolean, pct int, msg string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def event(number, minutes, task, step=1, ok=True):
    return (number, START + timedelta(minutes=minutes), task, step, "k", ok, 0, f"m{number}")


@pytest.fixture(autouse=True)
def few_stores(spark):
    """A store for each of two tasks is enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Feed:
    """A folder of events that a stream reads delivery by delivery, going on from its checkpoint."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)
        lv.use_rocksdb(spark)
        self.rows, self.sizes = [], []
        self.n_state = None

    def run(self, build, deliveries, mode="append"):
        for events in deliveries:
            self.spark.createDataFrame(events, SHAPE).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
            before = len(self.rows)
            stream = self.spark.readStream.schema(SHAPE).parquet(f"{self.path}/in")
            query = (
                build(stream).writeStream.outputMode(mode).foreachBatch(lambda b, _: self.rows.extend(b.collect()))
                .option("checkpointLocation", f"{self.path}/at").trigger(availableNow=True).start()
            )
            query.awaitTermination()
            self.sizes.append(len(self.rows) - before)
            self.n_state = sum(o.numRowsTotal for o in query.lastProgress.stateOperators)
        return self.rows


# --- J1 ---

def greedy(items, size, linger):
    out = []
    for item in sorted(items):
        if out and len(out[-1]) < size and item[0] < out[-1][0][0] + linger:
            out[-1].append(item)
        else:
            out.append([item])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=25), st.integers(1, 5), st.integers(1, 20), st.integers(0, 15))
def test_cut_batches(times, size, linger, step):
    """Whatever the pace of the watermark, batches are those of the whole, and a due batch does not wait."""
    items = [(t, i) for i, t in enumerate(times)]
    got, held, now = [], [], 0
    while now < 100:
        came = [x for x in items if now - step - 1 < x[0] <= now] if step else [x for x in items if x[0] == now]
        batches, held, wake = cut_batches(sorted(held + came), now, size, linger)
        got += batches
        assert not held or now <= wake + 1 <= held[0][0] + linger
        now += step + 1
    rest, left, _ = cut_batches(held, 10**6, size, linger)
    assert not left and got + rest == greedy([x for x in items if x[0] <= now - step - 1], size, linger)


def test_keyed_batches(spark, tmp_path):
    """In order of time, delivery by delivery: what is due leaves, and at the end only the heartbeat waits."""
    events = [event(i, i * 7 % 400, f"t{i % 3}") for i in range(120)]
    events.sort(key=lambda e: e[1])
    deliveries = [events[lo : lo + 40] for lo in (0, 40, 80)] + [[event(-1, 10**6, "end")], [event(-2, 10**6 + 1, "end")]]
    feed = Feed(spark, tmp_path)
    rows = feed.run(lambda s: lv.keyed_batches(s, size=4, linger="60 minutes", delay="1 minute"), deliveries)
    got = {}
    for r in rows:
        got.setdefault((r.key, r.batch_no), []).append((r.at_ms, r.item_id))
    for task in ("t0", "t1", "t2"):
        items = [(int(e[1].timestamp() * 1000), e[0]) for e in events if e[2] == task]
        mine = [sorted(got[k]) for k in sorted(got) if k[0] == task]
        assert mine == greedy(items, 4, 3_600_000)
    assert len(rows) == 120 and min(feed.sizes[:2]) > 0
    # The next numbers of three keys, and what the key of the heartbeat holds.
    assert {k[0] for k in got} == {"t0", "t1", "t2"}


# --- J2 ---

def test_first_reports_of_runs(spark, tmp_path):
    events = [
        event(5, 10, "a"), event(3, 5, "a", ok=False), event(4, 5, "a"), event(9, 200, "a"), event(10, 205, "a", ok=False),
        event(6, 50, "b", step=2), event(11, 190, "b", step=2),
    ]
    events.sort(key=lambda e: e[1])
    feed = Feed(spark, tmp_path)
    end = [[event(-1, 10**6, "end")]]
    rows = feed.run(lambda s: lv.first_reports_of_runs(s, "1 hour", "30 minutes"), [events[3::-1], events[4:], *end])
    assert sorted((r.task_id, r.step, r.n_reports, r.event_id, r.ok) for r in rows) == [
        ("a", 1, 2, 9, True), ("a", 1, 3, 3, False), ("b", 2, 1, 6, True), ("b", 2, 1, 11, True),
    ]
    assert feed.n_state == 1 and feed.sizes[1] > 0


def test_one_run_is_the_first_report(spark, tmp_path):
    """With a quiet time beyond the whole stream, the runs that are over are F11's first reports."""
    events = [event(i, i * 13 % 997, f"t{i % 17}", 1 + i % 3, i % 4 > 0) for i in range(300)]
    feed = Feed(spark, tmp_path)
    build = lambda s: lv.first_reports_of_runs(s, "2000 minutes", "2000 minutes")
    rows = feed.run(build, [events[:100], events[100:], [event(-1, 10**6, "end")]])
    batch = jb.first_reports(spark.createDataFrame(events, SHAPE), "step").collect()
    assert sorted((r.task_id, r.step, r.ok, r.msg) for r in rows) == sorted((r.task_id, r.step, r.ok, r.msg) for r in batch)
    assert len(batch) > 40 and feed.n_state == 1


# --- J3 ---

def test_hand_off_with_ready_tasks(spark, tmp_path):
    ready = spark.createDataFrame([("r1",), ("r2",), ("r2",)], "task_id string")
    first = [event(1, 0, "a", 1), event(2, 1, "a", 2), event(3, 2, "b", 1, False), event(4, 3, "r1", 2), event(5, 4, "c", 3)]
    second = [event(6, 90, "b", 2), event(7, 91, "a", 1, False), event(8, 92, "r2", 1, False), event(9, 93, "d", 2)]
    feed = Feed(spark, tmp_path)
    rows = feed.run(lambda s: lv.stage_hand_off(s, ready, "1 day", "1 minute"), [first, second])
    got = sorted(((r.task_id, r.action, r.event_id) for r in rows), key=str)
    assert got == [("a", "mix", 2), ("b", "drop", 3), ("d", "mix", 9), ("r1", "mix", None), ("r2", "mix", None)]
    # After a day without them the decided tasks have left; a new report of one is a new run.
    feed.run(lambda s: lv.stage_hand_off(s, ready, "1 day", "1 minute"), [[event(20, 5000, "z", 3)], [event(21, 9000, "b", 2)]])
    assert feed.n_state == 0 or feed.sizes[-1] == 1
    assert [(r.task_id, r.action, r.event_id) for r in feed.rows[5:]] == [("b", "mix", 21)]
    feed.run(lambda s: lv.stage_hand_off(s, ready, "1 day", "1 minute"), [[event(22, 99_000, "z", 3)]])
    assert feed.n_state == 0


# --- J5 ---

def wide(spark, events, groups):
    """The batch twin: newest status of each task, and the groups' rollup."""
    newest = {}
    for number, ts, task, step, _, ok, *_ in events:
        at = newest.setdefault(task, {})
        at[step] = max(at.get(step, ((START, -1), "")), ((ts, number), K.DONE if ok else K.FAILED))
    rows = [
        (task, groups.get(task, ""), *[at.get(s, (None, K.PENDING))[1] for s in K.STEPS]) for task, at in newest.items()
    ]
    shape = "task_id string, group_id string, s1_status string, s2_status string, s3_status string"
    return spark.createDataFrame(rows, shape)


def test_rollup_sends_what_changed(spark, tmp_path):
    groups = {"a": "g1", "b": "g1", "c": "g2", "d": "g2", "x": "g3"}
    table = spark.createDataFrame(list(groups.items()), "task_id string, group_id string")
    first = [event(i, i, t, s) for i, (t, s) in enumerate([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("n", 1)])]
    second = [event(10, 20, "b", 2, False), event(11, 3, "a", 1, False)]  # the latter is older than what is known
    third = [event(12, 40, "b", 2), event(13, 41, "b", 3), event(14, 42, "n", 1, False)]
    fourth = [event(15, 50, "c", 1)]
    feed = Feed(spark, tmp_path)
    feed.run(lambda s: lv.rollup_changes(s, table), [first, second, third, fourth])
    tasks, rolled, at = {}, {}, 0
    changes = []
    for n in feed.sizes:
        part = feed.rows[at : at + n]
        at += n
        changes.append((sorted(r.id for r in part if r.kind == "task"), sorted(r.id for r in part if r.kind == "group")))
        tasks |= {r.id: (r.group_id, r.s1_status, r.s2_status, r.s3_status) for r in part if r.kind == "task"}
        if groups_now := [r for r in part if r.kind == "group"]:
            rolled |= {r.group_id: tuple(r) for r in lv.group_state(spark.createDataFrame(groups_now, CHANGE)).collect()}
    # Groups whose figures stay are not sent again.
    assert changes == [(["a", "b", "c", "n"], ["g1", "g2"]), (["a", "b"], ["g1"]), (["b", "n"], ["g1"]), (["c"], [])]
    want = wide(spark, first + second + third + fourth, groups)
    assert tasks == {r.task_id: tuple(r)[1:] for r in want.collect()}
    rollup = {r.group_id: tuple(r) for r in jb.group_rollup(want).collect()}
    assert rolled.keys() == rollup.keys() == {"g1", "g2"}
    for g in rollup:
        assert rolled[g][:2] + rolled[g][3:] == rollup[g][:2] + rollup[g][3:] and rolled[g][2] == pytest.approx(rollup[g][2])


def test_idle_tasks_leave_their_group(spark, tmp_path):
    table = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "task_id string, group_id string")
    deliveries = [
        [event(1, 0, "a", 3), event(2, 1, "b", 1, False), event(3, 2, "c", 3)], [event(4, 100, "b", 1)], [event(5, 130, "q", 1)],
        [event(6, 10_000, "q", 1)], [event(7, 99_000, "q", 1)],
    ]
    feed = Feed(spark, tmp_path)
    feed.run(lambda s: lv.rollup_changes(s, table, "1 hour", "1 minute"), deliveries)
    last, at = [], 0
    for n in feed.sizes:
        part = [r for r in feed.rows[at : at + n] if r.kind == "group"]
        at += n
        last.append(sorted((r.id, r.n_tasks, r.n_done, r.n_failed) for r in part))
    assert last[0] == [("g", 2, 1, 1), ("h", 1, 1, 0)]
    flat = [x for part in last[1:] for x in part]
    # b is done well again, a and c have left after an hour without a word, b later.
    assert ("h", 0, 0, 0) in flat and flat[-1] == ("g", 0, 0, 0) and ("g", 1, 0, 0) in flat
