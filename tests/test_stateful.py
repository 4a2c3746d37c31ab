"""Stateful stream operators: stopped and gone on, against plain loops."""
import datetime as dt
import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnowry.config import CompactionLimits
from winnowry.streaming import chain, event_time, stateful

BEGIN = dt.datetime(2024, 1, 1)


def at(seconds):
    return BEGIN + dt.timedelta(seconds=seconds)


def in_parts(spark, rows, schema, build, name):
    """rows: (part, *row)."""
    df = spark.createDataFrame(rows, "part int, " + schema)
    return [tuple(r) for r in chain.in_parts(df, "part", 1 + max(r[0] for r in rows), build, name).collect()]


def test_state_store_setting_is_put_back(spark):
    before = spark.conf.get(stateful.PROVIDER, None)
    with stateful.state_store(spark):
        assert spark.conf.get(stateful.PROVIDER) == stateful.ROCKS
    assert spark.conf.get(stateful.PROVIDER, None) == before


def test_answers(spark):
    rows = [
        (0, "a", 1, 1, None), (0, "a", 2, 2, "x"), (0, "b", 1, 1, "first"), (0, "c", 1, 1, ""),
        (1, "a", 2, 3, "y"), (1, "a", 3, 1, "again"), (1, "b", 2, 1, "not this"), (1, "b", 1, 2, "more"), (1, "c", 3, 9, "late answer"),
    ]
    got = in_parts(spark, rows, "request_id string, attempt long, seq long, delta string", stateful.answers, "answers")
    assert sorted(got) == [("a", 2, 2, "x"), ("a", 2, 3, "y"), ("b", 1, 1, "first"), ("b", 1, 2, "more"), ("c", 3, 9, "late answer")]


def digest(*messages):
    return hashlib.sha256("\x1e".join(f"{r}\x1f{c}" for r, c in messages).encode()).hexdigest()


def test_memory(spark):
    say = lambda part, s, seq, kind, content=None, archived=None, dig=None, prev=None, t=0: (part, s, seq, kind, content, archived, dig, prev, at(t))
    first = digest(("user", "q0"), ("assistant", "a0"))
    rows = [
        say(0, "s", 0, "user", "q0"), say(0, "s", 1, "assistant", "a0"), say(0, "s", 2, "user", "lost"), say(0, "s", 3, "failed"), say(0, "s", 4, "user", "q1"),
        say(1, "s", 5, "assistant", "a1"), say(1, "s", 6, "commit", "  sum \n one ", 2, first, None), say(1, "s", 7, "commit", "again", 2, first, ""), say(1, "s", 8, "user", "q2"),
        say(2, "s", 9, "assistant", "a2"), say(2, "s", 10, "commit", "", 2, digest(("user", "q1"), ("assistant", "a1")), "sum one"),
        say(2, "s", 11, "commit", "two", 2, digest(("user", "q1"), ("assistant", "a1")), "sum"), say(2, "s", 12, "commit", "two", 2, digest(("user", "q1"), ("assistant", "a1")), "sum one"),
        say(0, "idle", 0, "user", "x"), say(0, "held", 0, "user", "x"), say(0, "held", 1, "reserve", "r1"),
        say(3, "z", 0, "user", "much later", t=40_000), say(4, "held", 2, "release", "r1", t=40_001), say(5, "z", 1, "user", "end", t=90_000),
    ]
    build = lambda df: stateful.memory(df, CompactionLimits(trigger_turns=2, trigger_chars=10**6, recent_turns=1), idle="1 hour", late="1 second")
    got = in_parts(spark, rows, stateful.TURNS, build, "memory")
    told = sorted((r for r in got if r[2] != "evicted"), key=lambda r: (r[0], r[1]))
    second = digest(("user", "q1"), ("assistant", "a1"))
    assert told == [
        ("s", 5, "plan", 2, first, 4), ("s", 6, "committed", 2, first, 2), ("s", 7, "stale", 2, first, 2), ("s", 9, "plan", 2, second, 4),
        ("s", 10, "stale", 2, second, 4), ("s", 11, "stale", 2, second, 4), ("s", 12, "committed", 2, second, 2),
    ]
    gone = [(r[0], r[5]) for r in got if r[2] == "evicted"]
    assert ("idle", 1) in gone and gone.count(("held", 1)) == 1  # held outlived the first timers, and went once it was released
    assert ("s", 2) in gone


def lru(rows, most):
    known, out = {}, []

    def trim(n, shard, seq):
        while len(known) > n:
            idle = next((k for k, held in known.items() if not held), None)
            if idle is None:
                return
            del known[idle]
            out.append((shard, idle, seq))

    for shard, name, seq, kind in rows:
        if kind == "release":
            if name in known:
                known[name] = max(0, known[name] - 1)
            trim(most, shard, seq)
            continue
        if name in known:
            known[name] = known.pop(name)
        else:
            trim(most - 1, shard, seq)
            known[name] = 0
        known[name] += kind == "reserve"
    return out


def test_evictions(spark):
    rng = random.Random(3)
    rows = [(0, f"s{rng.randrange(9)}", k, rng.choices(("use", "reserve", "release"), (5, 2, 2))[0]) for k in range(300)]
    parted = [(r[2] // 110, *r) for r in rows]
    got = in_parts(spark, parted, "shard long, session_id string, seq long, kind string", lambda df: stateful.evictions(df, 4), "evictions")
    assert sorted(got, key=lambda r: r[2]) == lru(rows, 4)
    with pytest.raises(ValueError):
        stateful.evictions(None, 0)


def test_in_order(spark):
    whole = [("sentence", k) if j == 0 else ("audio", k) for k in range(6) for j in (0, 1)] + [("done", 6)]
    rows = [("s", 0, i, t, n, at(n)) for n, (t, i) in enumerate(whole)]
    random.Random(5).shuffle(rows)
    parted = [(n // 5, *r) for n, r in enumerate(rows)]
    # a turn whose audio 0 never comes, until it comes too late
    gap = [("g", 1, 0, "sentence", 100, at(0)), ("g", 1, 1, "sentence", 101, at(1)), ("g", 1, 1, "audio", 102, at(2))]
    parted += [(0, *r) for r in gap] + [(3, "x", 9, 0, "sentence", 900, at(5000)), (4, "g", 1, 0, "audio", 103, at(9001)), (4, "g", 1, 1, "sentence", 104, at(9001))]
    got = in_parts(spark, parted, stateful.CLIENT, lambda df: stateful.in_order(df, gap="10 seconds", late="20 seconds"), "in_order")
    assert [(r[3], r[4]) for r in sorted((r for r in got if r[0] == "s"), key=lambda r: r[2])] == whole
    g = [r for r in got if r[0] == "g"]
    assert sorted((r[2], r[5]) for r in g if r[6] == "on time") == [(0, 100), (1, 101), (2, 102)]
    assert sorted((r[5], r[6]) for r in g if r[6] != "on time") == [(103, "late"), (104, "late")]


def test_in_order_of_many_waiting_events(spark):
    """Long turns, turns of one session with gaps of their own, and a gap that is given up behind which hundreds wait."""
    rows = [(k % 2, "s", turn, k, "sentence", 1000 * turn + k, at(0)) for turn in (0, 1) for k in range(700) if (turn, k) != (1, 20)]
    rows += [(0, "s", 2, 0, "sentence", 9, at(0)), (1, "s", 1, 6, "sentence", 10, at(0))]
    rows = [r for k, type_ in enumerate(("sentence", "audio")) for r in [(p, s, t, i, type_, 2 * e + k, ts) for p, s, t, i, _, e, ts in rows]]
    # whatever comes much later gives up the gaps that are left: sentence 20 of turn 1
    rows += [(2, "x", 0, 0, "sentence", 1, at(5000)), (3, "x", 0, 0, "audio", 2, at(9000))]
    got = in_parts(spark, rows, stateful.CLIENT, lambda df: stateful.in_order(df, gap="10 seconds", late="20 seconds"), "in_order")
    for turn, wanted in ((0, [k for k in range(700)]), (1, [k for k in range(700) if k != 20]), (2, [0])):
        told = sorted((r[2], r[4], r[3]) for r in got if r[:2] == ("s", turn) and r[6] == "on time")
        assert told == [(2 * n + k, i, type_) for n, i in enumerate(wanted) for k, type_ in enumerate(("sentence", "audio"))]
    assert sorted(r[5] for r in got if r[6] == "repeated") == [20, 21]


def test_in_order_calls_its_state_a_few_times_a_batch():
    calls = []

    class State(dict):
        def get(self):
            return dict.get(self, "v")

        def update(self, v):
            calls.append(v)
            self["v"] = v

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

        def removeKey(self, k):
            calls.append(k)
            del self[k]

        def getValue(self, k):
            calls.append(k)
            return self[k]

        def containsKey(self, k):
            calls.append(k)
            return k in self

        def exists(self):
            return "v" in self

        def keys(self):
            return dict.keys(self)

    class Handle:
        getValueState = getMapState = lambda self, *a: State()
        registerTimer = deleteTimer = lambda self, ms: calls.append(ms)

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    p = stateful._InOrder(1000)
    p.init(Handle())
    frame = pd.DataFrame([("s", 0, k, "sentence", k, at(0)) for k in range(1, 1000)], columns=["session_id", "turn", "index", "type", "event_id", "ts"])
    assert list(p.handleInputRows(("s", 0), iter([frame]), Times())) == []
    assert len(calls) < 20  # 999 events wait


def test_session_windows_drop_late_rows(spark):
    rows = [(0, "u", 1.0, at(0)), (0, "u", 2.0, at(5)), (1, "u", 4.0, at(1000)), (2, "v", 1.0, at(1001)), (3, "u", 100.0, at(7)), (3, "w", 0.0, at(9000))]
    got = in_parts(spark, rows, "user string, value double, ts timestamp", lambda df: event_time.session_windows(df, "10 seconds", "1 minute", "user"), "sessions")
    assert ("u", at(0), at(15), 2, 3.0) in got and ("u", at(1000), at(1010), 1, 4.0) in got
    assert not any(r[4] >= 100 for r in got)  # second 7 came when that window was long closed
    batch = event_time.session_windows(spark.createDataFrame([r[1:] for r in rows], "user string, value double, ts timestamp"), "10 seconds", "1 minute", "user")
    assert ("u", at(0), at(17), 3, 103.0) in [tuple(r) for r in batch.collect()]


def test_followed_within(spark):
    rows = [(0, "a", 1, "p", at(0)), (0, "a", 2, "p", at(100)), (1, "a", 3, "q", at(130)), (1, "a", 4, "q", at(161)), (2, "b", 5, "q", at(170)), (2, "b", 6, "p", at(170))]

    def build(df):
        return event_time.followed_within(df.where("kind = 'p'"), df.where("kind = 'q'"), "user", "1 minute", "10 minutes")

    got = in_parts(spark, rows, "user string, id long, kind string, ts timestamp", build, "followed")
    assert sorted((r[0], r[1], r[3]) for r in got) == [("a", 2, 3), ("b", 6, 5)]


def test_each_once(spark):
    rows = [(0, "k", 1, at(0)), (0, "k", 2, at(0)), (1, "k", 3, at(30)), (1, "m", 4, at(30))]
    got = in_parts(spark, rows, "key string, id long, ts timestamp", lambda df: event_time.each_once(df, "1 hour", "key"), "once")
    assert sorted(r[0] for r in got) == ["k", "m"]
