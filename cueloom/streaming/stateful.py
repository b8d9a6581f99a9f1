"""Keyed state of the live operators (J1, J3, J5): what one key remembers, and when it forgets.

Times are milliseconds of event time. Timers go off once the watermark has passed them, so results follow the data and
not the clock of the machine, and a stream that is read again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K


class KeyedBatches(StatefulProcessor):
    """The batches of one key. A batch leaves with ``size`` items, or ``linger_ms`` after its first.

    Rows are (at_ms, item_id, item); items wait until the watermark has passed them, since an earlier one may still come.
    """

    def __init__(self, size: int, linger_ms: int):
        self._size, self._linger = size, linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "at_ms long, item_id long, item string")
        self._next = handle.getValueState("next", "batch_no long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r.at_ms, r.item_id, r.item) for r in rows]
        return self._leave(key, came, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._leave(key, [], timerValues.getCurrentWatermarkInMs())

    def _leave(self, key, came: list[tuple], now: int) -> Iterator[Row]:
        held = [tuple(x) for x in self._waiting.get()] if self._waiting.exists() else []
        items = sorted(held + came, key=lambda x: x[:2])
        number = self._next.get()[0] if self._next.exists() else 0
        batches, rest, wake = cut_batches(items, now, self._size, self._linger)
        for batch in batches:
            for at_ms, item_id, item in batch:
                yield Row(key=key[0], batch_no=number, at_ms=at_ms, item_id=item_id, item=item)
            number += 1
        if batches:
            self._next.update((number,))
        if rest:
            if batches or came:
                self._waiting.put(rest)
            self._handle.registerTimer(wake)
        elif held:
            self._waiting.clear()

    def close(self) -> None:
        pass


def cut_batches(items: list[tuple], now: int, size: int, linger_ms: int) -> tuple[list[list[tuple]], list[tuple], int]:
    """The batches that are complete at ``now``, the items left in order, and when to look at those again."""
    batches, lo = [], 0
    while lo < len(items):
        closes, hi = items[lo][0] + linger_ms, lo + 1
        while hi < len(items) and hi - lo < size and items[hi][0] < closes:
            hi += 1
        due = min(closes, items[hi - 1][0]) if hi - lo == size else closes
        if due > now:
            # A timer goes off when the watermark is past it, not when it is there.
            return batches, items[lo:], max(due - 1, 0)
        batches.append(items[lo:hi])
        lo = hi
    return batches, [], 0


class HandOff(StatefulProcessor):
    """Speech done hands a task to mixing once; a failed step stops it.

    A task of the ready table enters without a report. What was decided is remembered for ``keep_ms`` and then forgotten.
    """

    def __init__(self, keep_ms: int):
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", "stage string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if not self._state.exists():
            self._state.update(("ready",))
            self._handle.registerTimer(1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self._state.exists():
            return
        # Rows of one trigger come in any order; the earliest decisive one counts.
        decisive = ((r.event_id, r.ok, r.at_ms) for r in rows if r.step <= 2 and (not r.ok or r.step == 2))
        best = min(decisive, default=None)
        if best is not None:
            event_id, ok, at_ms = best
            yield self._decided(key, "mix" if ok else "drop", event_id, at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._state.exists() and self._state.get()[0] == "ready":
            yield self._decided(key, "mix", None, timerValues.getCurrentWatermarkInMs())
        else:
            self._state.clear()

    def _decided(self, key, action: str, event_id: int | None, at_ms: int) -> Row:
        self._state.update((action,))
        self._handle.registerTimer(at_ms + self._keep)
        return Row(task_id=key[0], action=action, event_id=event_id)

    def close(self) -> None:
        pass


#: What a task, or a group of tasks, adds up to: tasks, finished steps, tasks done, running and failed.
COUNTERS = ("n_tasks", "n_steps", "n_done", "n_running", "n_failed")
_TASK = "group_id string, " + ", ".join(f"at{s} long, id{s} long, s{s} string" for s in K.STEPS)
CHANGE = "kind string, id string, group_id string, s1_status string, s2_status string, s3_status string, " + ", ".join(
    f"{c} long" for c in COUNTERS
)


def counted(statuses: tuple[str, ...]) -> tuple[int, ...]:
    """A task's share of its group's counters."""
    return (
        1, sum(s in K.FINISHED for s in statuses), int(statuses[-1] == K.DONE), int(K.RUNNING in statuses), int(K.FAILED in statuses),
    )


def change(kind: str, key: str, group: str | None, statuses: tuple[str | None, ...], counters: tuple[int, ...]) -> Row:
    return Row(kind=kind, id=key, group_id=group, s1_status=statuses[0], s2_status=statuses[1], s3_status=statuses[2],
               **dict(zip(COUNTERS, counters)))


class TaskChanges(StatefulProcessor):
    """J5, first step: the newest status of each step of a task.

    A trigger that changes a task gives its wide row (kind ``task``) and, for its group, the difference between what the
    task counts now and what it counted before (kind ``group``). With ``idle_ms`` a task without a report for so long
    leaves: its reports go, and its group gets all it counted back as a minus.
    """

    def __init__(self, idle_ms: int | None):
        self._idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._task = handle.getValueState("task", _TASK)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._task.update((initialState.group_id, *_NO_REPORT))

    def _statuses(self, task: tuple) -> tuple[str, ...]:
        return tuple(status or K.PENDING for status in task[3::3])

    def _counted(self, task: tuple) -> tuple[int, ...]:
        return counted(self._statuses(task)) if _reported(task) else (0,) * len(COUNTERS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._task.get()
        before = (None, *_NO_REPORT) if state is None else tuple(state)
        now = list(before)
        for r in rows:
            at = 3 * r.step - 2
            if now[at] is None or (r.at_us, r.event_id) >= (now[at], now[at + 1]):
                now[at : at + 3] = r.at_us, r.event_id, K.DONE if r.ok else K.FAILED
        self._task.update(tuple(now))
        if self._idle is not None:
            self._handle.registerTimer(_reported(now) // 1000 + self._idle)
        group = now[0] or ""
        new, old = self._counted(now), self._counted(before)
        yield change("task", key[0], group, self._statuses(now), new)
        if group and new != old:
            yield change("group", group, group, (None,) * 3, tuple(a - b for a, b in zip(new, old)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._task.get()
        last = None if state is None else _reported(state)
        if last is None or last // 1000 + self._idle > expiredTimerInfo.getExpiryTimeInMs():
            return
        task = tuple(state)
        # What remains of a task of the table is its group.
        if task[0]:
            self._task.update((task[0], *_NO_REPORT))
            yield change("group", task[0], task[0], (None,) * 3, tuple(-x for x in self._counted(task)))
        else:
            self._task.clear()

    def close(self) -> None:
        pass


_NO_REPORT = (None,) * (3 * len(K.STEPS))


def _reported(task) -> int | None:
    """When the newest report of a task came, in microseconds."""
    return max((at for at in task[1::3] if at is not None), default=None)


class GroupTotals(StatefulProcessor):
    """J5, second step: a group's counters, from the differences its tasks send. A group without tasks leaves.

    Rows of tasks pass.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counters = handle.getValueState("counters", ", ".join(f"{c} long" for c in COUNTERS))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] == "task":
            for r in rows:
                yield change("task", r.id, r.group_id, (r.s1_status, r.s2_status, r.s3_status), tuple(r[c] for c in COUNTERS))
            return
        state = self._counters.get()
        before = (0,) * len(COUNTERS) if state is None else tuple(state)
        total = list(before)
        group = None
        for r in rows:
            group = r.id
            for i, c in enumerate(COUNTERS):
                total[i] += r[c]
        if tuple(total) == before:
            return
        if total[0]:
            self._counters.update(tuple(total))
        else:
            self._counters.clear()
        yield change("group", group, group, (None,) * 3, tuple(total))

    def close(self) -> None:
        pass
