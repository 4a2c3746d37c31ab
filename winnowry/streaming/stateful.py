"""Stateful stream operators on ``transformWithState``: answers of retried requests, conversation memory, eviction of the longest unused, and ordered emission.

Their state (values, lists and maps with timers) lives in RocksDB; ``state_store`` sets that for the streams started within it. Rows of a
key are taken in the order of ``seq`` within a batch; across batches they arrive in order, but for ``in_order``, whose purpose is
that they needn't.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from winnowry.config import CompactionLimits

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, whatever the session's own setting."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)


def _rows(frames: Iterator[pd.DataFrame], *by: str) -> Iterator[tuple]:
    whole = pd.concat(list(frames))
    return whole.sort_values(list(by), kind="stable").itertuples(index=False) if by else whole.itertuples(index=False)


# --- answers -------------------------------------------------------------------------------------------------------------

ANSWERS = "request_id string, attempt long, seq long, delta string"


class _Answers(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answering = handle.getValueState("answering", "attempt long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chosen = self.answering.get()[0] if self.answering.exists() else None
        out = []
        for r in _rows(rows, "attempt", "seq"):
            if r.delta is None or r.delta == "":
                continue
            if chosen is None:
                chosen = r.attempt
                self.answering.update((chosen,))
            if r.attempt == chosen:
                out.append((key[0], r.attempt, r.seq, r.delta))
        if out:
            yield pd.DataFrame(out, columns=["request_id", "attempt", "seq", "delta"])

    def close(self) -> None:
        pass


def answers(deltas: DataFrame) -> DataFrame:
    """A stream of deltas (request_id, attempt, seq, delta), null for lines that bring none, to those of the attempt that answers: the first that brought
    one. A request is tried again only before its first delta, so what other attempts bring later isn't given out twice."""
    return deltas.select("request_id", "attempt", "seq", "delta").groupBy("request_id").transformWithStateInPandas(_Answers(), ANSWERS, "append", "none")


# --- memory --------------------------------------------------------------------------------------------------------------

TURNS = "session_id string, seq long, kind string, content string, archived int, digest string, previous string, ts timestamp"
MEMORY = "session_id string, seq long, kind string, archived int, digest string, kept int"


def prefix_digest(messages: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\x1e".join(f"{role}\x1f{content}" for role, content in messages).encode()).hexdigest()


class _Memory(StatefulProcessor):
    def __init__(self, limits: CompactionLimits, idle_ms: int):
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "role string, content string")
        self.summary = handle.getValueState("summary", "summary string")
        self.reserved = handle.getMapState("reserved", "request string", "since long")
        self.used = handle.getValueState("used", "ms long, timer long")

    def _due(self, kept: list[tuple[str, str]]) -> int:
        """How many leading messages a plan archives; 0 for none. A last user message without reply belongs to no turn."""
        turns = (len(kept) - (bool(kept) and kept[-1][0] == "user")) // 2
        over = turns >= self.limits.trigger_turns or sum(len(c) for _, c in kept) >= self.limits.trigger_chars
        return 2 * (turns - self.limits.recent_turns) if over and turns > self.limits.recent_turns else 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.messages.get())
        summary = self.summary.get()[0] if self.summary.exists() else ""
        last, timer = self.used.get() if self.used.exists() else (0, 0)
        out = []
        for r in _rows(rows, "seq"):
            last = max(last, int(r.ts.timestamp() * 1000))
            if r.kind in ("user", "assistant"):
                kept.append((r.kind, r.content or ""))
                if n := self._due(kept):
                    out.append((key[0], r.seq, "plan", n, prefix_digest(kept[:n]), len(kept)))
            elif r.kind == "failed":  # no reply came
                if kept and kept[-1][0] == "user":
                    kept.pop()
            elif r.kind == "commit":
                told = " ".join((r.content or "").split())
                n = int(r.archived)
                fits = bool(told) and n <= len(kept) and prefix_digest(kept[:n]) == r.digest and summary == (r.previous or "")
                if fits:
                    kept, summary = kept[n:], told[: self.limits.summary_chars]
                out.append((key[0], r.seq, "committed" if fits else "stale", n, r.digest, len(kept)))
            elif r.kind == "reserve":
                self.reserved.updateValue((r.content,), (last,))
            elif r.kind == "release" and self.reserved.containsKey((r.content,)):
                self.reserved.removeKey((r.content,))
        if kept:
            self.messages.put(kept)
        else:
            self.messages.clear()
        self.summary.update((summary,))
        self._wait(last, timer)
        if out:
            yield self._frame(out)

    def _wait(self, last: int, timer: int) -> None:
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        self.used.update((last, last + self.idle_ms))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["session_id", "seq", "kind", "archived", "digest", "kept"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if any(True for _ in self.reserved.keys()):  # somebody holds it: look again later
            at = expiredTimerInfo.getExpiryTimeInMs()
            self.handle.registerTimer(at + self.idle_ms)
            self.used.update((self.used.get()[0], at + self.idle_ms))
            return
        kept = sum(1 for _ in self.messages.get())
        for state in (self.messages, self.summary, self.reserved, self.used):
            state.clear()
        yield self._frame([(key[0], None, "evicted", None, None, kept)]).astype({"seq": "Int64", "archived": "Int32"})

    def close(self) -> None:
        pass


def memory(turns: DataFrame, limits: CompactionLimits | None = None, idle: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Conversation memory of a stream of session rows (``TURNS``): ``user`` and ``assistant`` messages, ``failed`` (the last user message had no reply),
    ``commit`` (a summary of the first ``archived`` messages), ``reserve`` and ``release`` (content names the request).

    Gives a ``plan`` whenever a message makes some archivable, with the digest of that prefix; ``committed`` where a commit's prefix is still the
    session's and ``previous`` its summary, else ``stale``; ``evicted`` once event time is ``idle`` past the session's last row and nobody holds it."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = turns.withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(_Memory(limits or CompactionLimits(), ms), MEMORY, "append", "eventTime")


# --- eviction of the longest unused --------------------------------------------------------------------------------------

EVICTED = "shard long, session_id string, seq long"


class _Longest(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "session_id string", "used long, held int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: [used, held] for k, (used, held) in self.sessions.iterator()}
        before, out = {k: tuple(v) for k, v in known.items()}, []

        def trim(most: int, seq: int) -> None:
            while len(known) > most:
                idle = [(used, name) for name, (used, held) in known.items() if not held]
                if not idle:
                    break
                name = min(idle)[1]
                del known[name]
                out.append((key[0], name, seq))

        for r in _rows(rows, "seq"):
            if r.kind == "release":
                if r.session_id in known:
                    known[r.session_id][1] = max(0, known[r.session_id][1] - 1)
                trim(self.most, r.seq)
                continue
            if r.session_id not in known:
                trim(self.most - 1, r.seq)
                known[r.session_id] = [r.seq, 0]
            known[r.session_id][0] = r.seq
            known[r.session_id][1] += r.kind == "reserve"
        for name in before.keys() - known.keys():
            self.sessions.removeKey((name,))
        for name, v in known.items():
            if before.get(name) != tuple(v):
                self.sessions.updateValue((name,), tuple(v))
        if out:
            yield pd.DataFrame(out, columns=["shard", "session_id", "seq"])

    def close(self) -> None:
        pass


def evictions(uses: DataFrame, most: int) -> DataFrame:
    """A stream of uses (shard, session_id, seq, kind: use, reserve or release) to the sessions that go so that a shard keeps ``most``: the longest unused that
    nobody holds, when another comes or one is released. Held ones stay, even above the limit. A shard's state has about ``most`` sessions."""
    if most < 1:
        raise ValueError("most must be positive")
    return uses.select("shard", "session_id", "seq", "kind").groupBy("shard").transformWithStateInPandas(_Longest(most), EVICTED, "append", "none")


# --- ordered emission ----------------------------------------------------------------------------------------------------

CLIENT = "session_id string, turn long, index int, type string, event_id long, ts timestamp"
ORDERED = "session_id string, turn long, place long, type string, index int, event_id long, state string"


def position(index: int, type_: str) -> int:
    """Sentence k, then its audio (or that it failed), then sentence k + 1; ``done`` and ``error`` carry the number of sentences."""
    return 2 * int(index) + (type_ in ("audio", "audio_error"))


#: Places of a turn that are kept together in one entry of its state, and waiting events of a turn that stand in its session's own entry.
PLACES, FEW = 256, 64


class _Turn:
    """What is known of a turn: the next position, the next place, its timer (0 for none), the blocks that wait in the state, and by block what was read or is new."""

    def __init__(self, at: int = 0, place: int = 0, timer: int = 0, held: list[int] = (), few: list[list] = ()):
        self.at, self.place, self.timer, self.held = at, place, timer, set(held)
        self.blocks: dict[int, dict[int, list]] = {}
        for p, *event in few:
            self.blocks.setdefault(p // PLACES, {})[p] = event


class _InOrder(StatefulProcessor):
    """Each call to the state costs far more than a row, so a session's turns are kept in one entry. Where more than FEW events of a turn wait, they're kept in blocks of places, each read and
    written once a batch at most. Rows that go out at once aren't kept."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "turns string")
        self.waiting = handle.getMapState("waiting", "turn long, block long", "events string")

    def _turns(self) -> dict[int, _Turn]:
        told = self.session.get()
        return {turn: _Turn(*rest) for turn, *rest in json.loads(told[0])} if told else {}

    def _block(self, turn: int, t: _Turn, b: int) -> dict[int, list]:
        if b not in t.blocks:
            t.blocks[b] = {p: event for p, *event in json.loads(self.waiting.getValue((turn, b))[0])} if b in t.held else {}
        return t.blocks[b]

    def _drain(self, name: str, turn: int, t: _Turn) -> list[tuple]:
        out = []
        while (event := self._block(turn, t, t.at // PLACES).pop(t.at, None)) is not None:
            out.append((name, turn, t.place, *event, "on time"))
            t.at, t.place = t.at + 1, t.place + 1
        return out

    def _settle(self, turn: int, t: _Turn, now: int) -> None:
        """What was touched and still waits is put back. A timer is due while something waits behind a gap."""
        if t.held or sum(map(len, t.blocks.values())) > FEW:
            for b, events in t.blocks.items():
                if events:
                    self.waiting.updateValue((turn, b), (json.dumps([(p, *event) for p, event in events.items()]),))
                    t.held.add(b)
                elif b in t.held:
                    self.waiting.removeKey((turn, b))
                    t.held.remove(b)
            t.blocks = {}
        t.timer = now + self.gap_ms if t.held or any(t.blocks.values()) else 0

    def _keep(self, turns: dict[int, _Turn], before: set[int], after: set[int]) -> None:
        """Puts the turns back; turns due at one time share a timer."""
        for ms in before - after:
            self.handle.deleteTimer(ms)
        for ms in after - before:
            self.handle.registerTimer(ms)
        few = lambda t: [(p, *event) for events in t.blocks.values() for p, event in events.items()]
        self.session.update((json.dumps([(turn, t.at, t.place, t.timer, sorted(t.held), few(t)) for turn, t in turns.items()]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turns, late, out = self._turns(), [], []
        before, latest = {t.timer for t in turns.values()} - {0}, {}
        for frame in rows:
            for turn, index, type_, event, ms in zip(*(frame[c].tolist() for c in ("turn", "index", "type", "event_id")), (int(x.timestamp() * 1000) for x in frame["ts"]), strict=True):
                t = turns.setdefault(turn, _Turn())
                latest[turn] = max(latest.get(turn, 0), ms)
                p = position(index, type_)
                if p < t.at or p in self._block(turn, t, p // PLACES):
                    late.append((key[0], turn, None, type_, index, event, "late" if p < t.at else "repeated"))
                else:
                    self._block(turn, t, p // PLACES)[p] = [type_, int(index), int(event)]
        watermark = timerValues.getCurrentWatermarkInMs()
        for turn, ms in latest.items():
            out += self._drain(key[0], turn, turns[turn])
            self._settle(turn, turns[turn], max(ms, watermark))
        self._keep(turns, before, {t.timer for t in turns.values()} - {0})
        if out or late:
            yield self._frame(out + late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What was waited for isn't coming: go on at what is there."""
        turns, now, out = self._turns(), expiredTimerInfo.getExpiryTimeInMs(), []
        before = {t.timer for t in turns.values()} - {0, now}
        for turn, t in turns.items():
            if t.timer == now:
                first = min([*t.held, *(b for b, events in t.blocks.items() if events)])
                t.at = min(self._block(turn, t, first))
                out += self._drain(key[0], turn, t)
                self._settle(turn, t, now)
        self._keep(turns, before, {t.timer for t in turns.values()} - {0})
        if out:
            yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        told = dict(zip(("session_id", "turn", "place", "type", "index", "event_id", "state"), map(list, zip(*out, strict=True)), strict=True))
        return pd.DataFrame(told | {"place": pd.array(told["place"], "Int64")})

    def close(self) -> None:
        pass


def in_order(events: DataFrame, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """A stream of client events (``CLIENT``) in any order to the order in which a client plays them: event k + 1 is held until k is out. ``place`` numbers a
    turn's events as they're given out. A gap is given up once event time is ``gap`` past the last event of the turn's batch; what comes for a place
    already passed is ``late``, a second event for a waiting place ``repeated``, both without a place. Events whose own time is more than ``late`` behind
    the stream are dropped by the watermark."""
    ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    return events.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(_InOrder(ms), ORDERED, "append", "eventTime")
