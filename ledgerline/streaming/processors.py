"""Keyed state that follows event time, on transformWithState.

Rows wait in state until the watermark has passed them and are then taken in
the order of their times, so that what comes out doesn't depend on the order in
which they came in or on how they were cut into batches: it is what a batch
over all of them gives. Rows that come after the watermark has passed them are
left out by Spark. Needs the RocksDB state store:

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "10 minutes"
#: Milliseconds in which an equal check or a session's next baseline is refused
SUPPRESS_MS, BASELINE_MS = 15_000, 60_000
#: Latencies, sessions, files a session and milliseconds that are kept
LATENCIES, SESSIONS, FILES, SESSION_MS = 1_000, 256, 200, 86_400_000
#: Blocks of a finding until it is passed on, and the states in which it stays
MOST_BLOCKS, STICKY = 3, ("deferred", "escalated")


_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<double>": T.ArrayType(T.DoubleType())}


def struct(fields: str) -> T.StructType:
    """`name type, ...` as a type, without a session: workers have none."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


class InOrder(StatefulProcessor):
    """Base: holds rows back until the watermark has passed them. `row` is their
    schema, which begins with `ms` (the time, in milliseconds) and `id` (its tie
    breaker); `take` gets what is due, sorted, and gives rows to put out."""

    row: str
    out: str

    def open(self, handle: StatefulProcessorHandle) -> None:
        """The state variables of the operator."""

    def take(self, key: tuple, due: list[tuple], timers) -> Iterable[tuple]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", struct(self.row))
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in struct(self.row).fields]
        for frame in rows:
            new = frame[names]
            self.waiting.appendList([tuple(None if _missing(x) else _plain(x) for x in r) for r in new.itertuples(index=False, name=None)])
            self.handle.registerTimer(int(new["ms"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= upto), key=lambda r: (r[0], r[1]))
        later = [r for r in rows if r[0] > upto]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        else:
            self.waiting.clear()
        found = list(self.take(tuple(key), due, timerValues)) if due else list(self.expire(tuple(key), upto))
        if found:
            yield pd.DataFrame(found, columns=[f.name for f in struct(self.out).fields])

    def expire(self, key: tuple, now: int) -> Iterable[tuple]:
        """A timer has come of age and no row was due."""
        return ()

    def close(self) -> None:
        pass


def _missing(x) -> bool:
    return x is None or (isinstance(x, float) and x != x) or x is pd.NaT


def _plain(x):
    return x.tolist() if hasattr(x, "tolist") else x


class OncePer(InOrder):
    """accepted: the row comes at least `every` milliseconds after the last accepted one of its key."""

    row, out = "ms long, id long", "id long, accepted boolean"

    def __init__(self, every: int):
        self.every = every

    def open(self, handle):
        self.last = handle.getValueState("last", struct("ms long"))

    def take(self, key, due, timers):
        last = self.last.get()[0] if self.last.exists() else None
        for ms, i in due:
            ok = last is None or ms - last >= self.every
            last = ms if ok else last
            yield i, ok
        self.last.update((last,))
        self.handle.registerTimer(last + self.every)

    def expire(self, key, now):
        """The mark goes when it refuses nothing any more."""
        if self.last.exists() and now - self.last.get()[0] >= self.every:
            self.last.clear()
        return ()


class LatencyRing(InOrder):
    """After each row n, p50, p95, p99 of its key's newest `keep` latencies, and the errors so far."""

    row, out = "ms long, id long, latency double, error boolean", "id long, n long, p50 double, p95 double, p99 double, errors long"

    def __init__(self, keep: int = LATENCIES):
        self.keep = keep

    def open(self, handle):
        self.ring = handle.getListState("ring", struct("latency double"))
        self.errors = handle.getValueState("errors", struct("n long"))

    def take(self, key, due, timers):
        held = [r[0] for r in self.ring.get()] if self.ring.exists() else []
        errors = self.errors.get()[0] if self.errors.exists() else 0
        for _, i, latency, error in due:
            held = [*held, latency or 0.0][-self.keep :]
            errors += bool(error)
            s = pd.Series(held)
            yield i, len(held), *s.quantile([0.5, 0.95, 0.99]).tolist(), errors
        self.ring.put([(x,) for x in held])
        self.errors.update((errors,))


def review(state: tuple[str, int], event: str) -> tuple[str, int]:
    """(status, blocks) of a finding after an event.

    `seen`: found by an edit; opens it unless it is open, deferred or escalated.
    `stop`: a session's end finds it still there: an open one blocks, until it
    has done so MOST_BLOCKS times; then it is escalated instead. `gone`: the
    session's end finds it no longer there; whatever its state it is resolved.
    `defer`, `escalate`, `resolve`: someone decides. Others change nothing.
    """
    status, blocks = state
    if event == "seen":
        return ("open", 0 if status in ("new", "resolved") else blocks) if status not in STICKY else state
    if event in ("gone", "resolve"):
        return ("resolved", blocks) if status != "new" else state
    if event == "stop" and status == "open":
        return ("escalated", blocks) if blocks >= MOST_BLOCKS else ("open", blocks + 1)
    if event in ("defer", "escalate") and status != "new":
        return "deferred" if event == "defer" else "escalated", blocks
    return state


class Reviews(InOrder):
    """status and blocks of a finding after each of its events, and whether the event blocked."""

    row, out = "ms long, id long, event string", "id long, status string, blocks long, blocked boolean"

    def open(self, handle):
        self.state = handle.getValueState("state", struct("status string, blocks long"))

    def take(self, key, due, timers):
        now = tuple(self.state.get()) if self.state.exists() else ("new", 0)
        for _, i, event in due:
            after = review(now, event)
            yield i, *after, event == "stop" and after[1] > now[1]
            now = after
        self.state.update(now)


class BaselineCache(InOrder):
    """What a store of baselines, least recently used out first, answers: for a
    `read` the baseline of (session, path) if it is held, else null.

    A `write` keeps the first baseline of a path. Both move the session to the
    end; over `sessions` the first one goes. Over `files` the session's oldest
    other path goes. A read first drops all sessions that weren't written to for
    `ttl` milliseconds. State: a map of sessions and one of paths, for each key
    no more than sessions x files baselines.
    """

    row = "ms long, id long, session string, path string, kind string, baseline array<double>"
    out = "id long, kind string, baseline array<double>"

    def __init__(self, sessions: int = SESSIONS, files: int = FILES, ttl: int = SESSION_MS):
        self.sessions, self.files, self.ttl = sessions, files, ttl

    def open(self, handle):
        self.clock = handle.getValueState("clock", struct("n long"))
        self.of_session = handle.getMapState("sessions", struct("session string"), struct("used long, written long"))
        self.of_path = handle.getMapState("paths", struct("session string, path string"), struct("made long, baseline array<double>"))

    def _drop(self, session: str, held: dict, paths: dict) -> None:
        del held[session]
        self.of_session.removeKey((session,))
        for path in paths.pop(session, {}):
            self.of_path.removeKey((session, path))

    def take(self, key, due, timers):
        n = self.clock.get()[0] if self.clock.exists() else 0
        held = {k[0]: list(v) for k, v in self.of_session.iterator()} if self.of_session.exists() else {}
        paths: dict[str, dict] = {}
        for (session, path), (made, baseline) in self.of_path.iterator() if self.of_path.exists() else ():
            paths.setdefault(session, {})[path] = (made, baseline)
        touched: set = set()
        for ms, i, session, path, kind, baseline in due:
            n += 1
            if kind == "read":
                for old in [s for s, (_, written) in held.items() if self.ttl > 0 and written < ms - self.ttl]:
                    self._drop(old, held, paths)
                    touched.discard(old)
                if session in held:
                    held[session][0] = n
                    touched.add(session)
                found = paths.get(session, {}).get(path)
                yield i, kind, None if found is None or found[1] is None else list(found[1])
                continue
            held[session] = [n, ms]
            touched.add(session)
            mine = paths.setdefault(session, {})
            if path not in mine:
                mine[path] = (n, baseline)
                self.of_path.updateValue((session, path), (n, baseline))
            while len(held) > self.sessions:
                first = min(held, key=lambda s: held[s][0])
                self._drop(first, held, paths)
                touched.discard(first)
            if len(mine) > self.files:
                oldest = min((p for p in mine if p != path), key=lambda p: mine[p][0])
                del mine[oldest]
                self.of_path.removeKey((session, oldest))
            yield i, kind, None
        for session in touched:
            self.of_session.updateValue((session,), tuple(held[session]))
        self.clock.update((n,))


def in_order(stream: DataFrame, keys: list[str], processor: InOrder, ts: str = "ts", late: str = LATE) -> DataFrame:
    """The processor over a stream with a time column, by key: keys and what the
    processor puts out. Other columns must bear the names of the processor's row."""
    from pyspark.sql import functions as F

    named = [f.name for f in struct(processor.row).fields if f.name != "ms"]
    rows = stream.withWatermark(ts, late).select(*keys, ts, F.unix_millis(F.col(ts)).alias("ms"), *named)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, struct(processor.out), "append", "EventTime")


def suppressed_checks(stream: DataFrame, late: str = LATE) -> DataFrame:
    """id, accepted: a check (file_path, checksum) that isn't a repetition within 15 seconds."""
    return in_order(stream, ["file_path", "checksum"], OncePer(SUPPRESS_MS), late=late)


def limited_baselines(stream: DataFrame, late: str = LATE) -> DataFrame:
    """id, accepted: a session's request for a baseline, one in 60 seconds."""
    return in_order(stream, ["session"], OncePer(BASELINE_MS), late=late)
