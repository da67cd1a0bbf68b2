"""Sessions of the stream against a plain loop over the batches."""

import datetime
import random
import zlib

import numpy as np
import pytest

from glossa.llm import sessions

GAP, LATE = 30 * 60_000_000, 240 * 3_600_000_000
SCHEMA = "click_id long, client_id long, ts timestamp_ntz, arrived_at timestamp_ntz, slot string, US long"
EPOCH = datetime.datetime(1970, 1, 1)


def micros(t):
    return (t - EPOCH) // datetime.timedelta(microseconds=1)


def brute(rows, batches=8):
    """The contract, batch by batch, with a list of open sessions a client."""
    first = {}
    for i, client, ts, arrived in rows:
        if None not in (i, client, ts):
            row = (arrived is not None, arrived or EPOCH, ts, client)
            first[i] = min(first.get(i, row), row)
    hours = [micros(a) // 3_600_000_000 for known, a, _, _ in first.values() if known]
    lo, hi = min(hours, default=0), max(hours, default=0)
    dealt = [[] for _ in range(batches)]
    for i, (known, arrived, ts, client) in first.items():
        b = 0
        if known:
            late = zlib.crc32(f"{client}:{micros(ts) // 3_600_000_000}".encode()) % 3 == 0
            b = min(batches * (micros(arrived) // 3_600_000_000 - lo) // (hi - lo + 1) + late, batches - 1)
        dealt[b].append((client, micros(ts), zlib.crc32(str(i).encode())))
    out, left, top, before = [], [], None, None
    for b, batch in enumerate(dealt):
        top = max([t for _, t, _ in batch] + ([] if top is None else [top]), default=None)
        fresh = [(c, t, t, 1, k, 0, False) for c, t, k in batch if before is None or t >= before]
        merged = []
        for part in sorted(fresh + left, key=lambda p: p[:2]):
            if merged and merged[-1][0][0] == part[0] and part[1] - max(p[2] for p in merged[-1]) <= GAP:
                merged[-1].append(part)
            else:
                merged.append([part])
        before, left = None if top is None else top - LATE, []
        for group in merged:
            old = sum(p[6] for p in group)
            done = (group[0][0], group[0][1], max(p[2] for p in group), sum(p[3] for p in group), sum(p[4] for p in group), sum(p[5] for p in group) + max(old - 1, 0))
            if before is not None and done[2] + GAP < before:
                out.append((*done, b))
            else:
                left.append((*done, True))
    return sorted(out + [(*p[:6], batches) for p in left])


def found(spark, rows, **how):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in sessions.close_sessions(table, **how).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        ts = start + datetime.timedelta(minutes=rng.randrange(60 * 24 * 40), microseconds=rng.choice([0, 0, 1, 999_999]))
        if rng.random() < 0.5 and rows and rows[-1][2]:
            ts = rows[-1][2] + datetime.timedelta(minutes=rng.choice([-30, -7, 0, 30, 31]))
        arrived = ts + datetime.timedelta(hours=rng.choice([0, 0, 1, 50, 300]))
        rows.append((i if rng.random() < 0.97 else rng.randrange(i + 1), rng.choice([1, 1, 1, rng.randrange(6), None]), ts if rng.random() < 0.98 else None, arrived if rng.random() < 0.97 else None))
    assert found(spark, rows, group_rows=100, store_rows=400) == brute(rows)


def test_empty_and_odd_rows(spark):
    at = datetime.datetime(2024, 1, 1)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, at, at), (1, None, at, at), (2, 1, None, at)]) == []
    rows = [(5, 1, at, None), (5, 1, at, None)]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 1


class Calls:
    """A state handle that counts trips to the state server."""

    def __init__(self):
        self.held, self.timers, self.trips = [], set(), 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.trips += 1
        return iter(self.held)

    def put(self, rows):
        self.trips += 1
        self.held = list(rows)

    def clear(self):
        self.put([])

    def registerTimer(self, at):
        self.trips += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.trips += 1
        self.timers.remove(at)


def test_a_group_costs_a_few_trips_whatever_it_holds():
    gap, calls = sessions.MINUTE_US, Calls()

    def batch(floors, parts):
        processor = sessions.Sessions(gap, floors)
        processor.init(calls)
        calls.trips = 0
        out = list(processor.handleInputRows((0,), iter([{"packed": np.array(parts, dtype=np.int64).tobytes()}]), None))
        assert calls.trips <= 4
        assert len(calls.timers) == bool(calls.held)
        return out

    at = [3 * gap * i for i in range(1000)]
    assert batch([0], [(7, t, t, 1, t) for t in at]) == []
    assert calls.timers == {gap // 1000 - 1} and len(calls.held) == 1000
    closed = batch([0, at[500] + gap], [(7, at[500] + gap, at[501] - gap, 2, 5)])
    assert [(r.first_us, r.n_clicks, r.n_merges, r.close_batch) for r in sorted(closed)] == [(t, 1, 0, 1) for t in at[:500]]
    assert len(calls.held) == 499 and calls.timers == {(at[501] + gap) // 1000 - 1}
    assert [r[1:6] for r in calls.held if r[1] == at[500]] == [(at[500], at[501], 4, at[500] + at[501] + 5, 1)]
