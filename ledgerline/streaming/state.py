"""Streaming versions of the keyed operators, on Structured Streaming's state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.streaming.processors import review

RETRY_MS, SUPPRESS_MS, HISTORY = 120_000, 15_000, 1_000
#: rows that come later than this behind the newest are left out
LATE = "10 minutes"


def _milliseconds(ts: pd.Series) -> pd.Series:
    return pd.to_datetime(ts).astype("datetime64[ms]").astype("int64")


def _expire(state: GroupState, last_ms: int, ttl_ms: int) -> None:
    """Drop the state once the watermark is ttl_ms past its last time."""
    state.setTimeoutTimestamp(max(int(last_ms), state.getCurrentWatermarkMs()) + ttl_ms)


def retries(stream: DataFrame, within_ms: int = RETRY_MS, ttl_ms: int = 86_400_000) -> DataFrame:
    """decision_id, retry_after_block: the file's last block in that session is at
    most `within_ms` old. State: the last block's time, dropped after ttl_ms.
    Rows of a key are taken in the order of their times within a batch; a block
    that comes in a later batch than newer ones doesn't set the time back, and a
    row from before the last block counts as no retry."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "decision_id"])
        out = []
        for d, when, decision in zip(rows["decision_id"], _milliseconds(rows["ts"]), rows["decision"], strict=True):
            out.append((d, last is not None and 0 <= when - last <= within_ms))
            if decision in ("block", "deny"):
                last = when if last is None else max(last, when)
        if last is not None:
            state.update((int(last),))
            _expire(state, last, ttl_ms)
        yield pd.DataFrame(out, columns=["decision_id", "retry_after_block"])

    return stream.withWatermark("ts", LATE).groupBy("session_id", "file_path").applyInPandasWithState(
        run, "decision_id long, retry_after_block boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def suppressed(stream: DataFrame, within_ms: int = SUPPRESS_MS, ttl_ms: int = 3_600_000) -> DataFrame:
    """decision_id, repeated: a check of the same content ran less than within_ms
    before; the mark is renewed only once it has expired."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "decision_id"])
        out = []
        for d, when in zip(rows["decision_id"], _milliseconds(rows["ts"]), strict=True):
            again = mark is not None and 0 <= when - mark < within_ms
            out.append((d, again))
            if not again:
                mark = when if mark is None else max(mark, when)
        state.update((int(mark),))
        _expire(state, mark, ttl_ms)
        yield pd.DataFrame(out, columns=["decision_id", "repeated"])

    return stream.withWatermark("ts", LATE).groupBy("file_path", "checksum").applyInPandasWithState(
        run, "decision_id long, repeated boolean", "mark long", "append", GroupStateTimeout.EventTimeTimeout
    )


def history(stream: DataFrame, keep: int = HISTORY, ttl_ms: int = 86_400_000) -> DataFrame:
    """session_id, n, p50, p95 of the session's newest `keep` latencies, after each batch that brings some."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "decision_id"])
        held = (held + [int(x) for x in rows["latency_ms"].dropna()])[-keep:]
        state.update((json.dumps(held),))
        _expire(state, int(_milliseconds(rows["ts"]).iloc[-1]), ttl_ms)
        s = pd.Series(held, dtype="float64")
        yield pd.DataFrame({"session_id": [key[0]], "n": [len(held)], "p50": [s.quantile(0.5)], "p95": [s.quantile(0.95)]})

    return stream.withWatermark("ts", LATE).groupBy("session_id").applyInPandasWithState(
        run, "session_id long, n long, p50 double, p95 double", "held string", "update", GroupStateTimeout.EventTimeTimeout
    )


def windowed_rate(stream: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    """Share of blocked rows per window; rows later than the watermark are left out."""
    blocked = F.avg(F.col("decision").isin("block", "deny").cast("double"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("n"), blocked.alias("rate"))


def review_state(events: list[str]) -> tuple[str, int]:
    """(status, blocks) of a finding after all of its events, in order."""
    state = ("new", 0)
    for e in events:
        state = review(state, e)
    return state


def reviews(findings: DataFrame) -> DataFrame:
    """finding_id, status, blocks of each finding's events (finding_id, seq, event) in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        status, n = review_state(frame.sort_values("seq")["event"].tolist())
        return pd.DataFrame({"finding_id": [frame["finding_id"].iloc[0]], "status": [status], "blocks": [n]})

    return findings.groupBy("finding_id").applyInPandas(run, f"finding_id {dict(findings.dtypes)['finding_id']}, status string, blocks long")
