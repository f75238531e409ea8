"""Keyed state in event time: shuffled, late and cut into batches anyhow, a stream gives what plain loops over all rows give."""

import collections
import datetime as dt
import math
import random

import pandas as pd
import pytest

from ledgerline.streaming import processors as P

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def streamed(spark, tmp_path, rows, schema, make, span=240):
    """What comes out of rows (ms first) that come up to `span` seconds late, in four batches,
    and a last row of each key far later, which pushes the watermark past all others."""
    rng = random.Random(1)
    arrival = sorted(rows, key=lambda r: (r[0] / 1000 + rng.uniform(0, span)))
    size = -(-len(arrival) // 4)
    for k in range(4):
        part = [(START + dt.timedelta(milliseconds=r[0]), *r[1:]) for r in arrival[k * size : (k + 1) * size]]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    ends = {r[2]: (START + dt.timedelta(days=9), -1, *r[2:]) for r in rows}
    spark.createDataFrame(list(ends.values()), schema).coalesce(1).write.parquet(str(tmp_path / "in/b9"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    name = f"out{random.randrange(10**9)}"
    q = make(src).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(150) and q.exception() is None
    return [r for r in spark.table(name).collect() if r.id != -1]


def by_key(rows, key=2):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out[r[key]].append(r)
    return out


def test_one_in_an_interval(spark, tmp_path, rocksdb):
    """Equal times, gaps of exactly the interval, keys of a row."""
    rng = random.Random(2)
    rows = [(rng.randrange(0, 60) * 5_000, i, f"k{rng.randrange(4)}") for i in range(120)] + [(0, 500, "alone")]
    want = {}
    for some in by_key(rows).values():
        last = None
        for ms, i, _ in some:
            want[i] = last is None or ms - last >= P.SUPPRESS_MS
            last = ms if want[i] else last
    got = streamed(spark, tmp_path, rows, "ts timestamp, id long, file_path string", lambda s: P.in_order(s, ["file_path"], P.OncePer(P.SUPPRESS_MS)))
    assert {r.id: r.accepted for r in got} == want and len(got) == len(rows) and len(set(want.values())) == 2


def test_latency_ring(spark, tmp_path, rocksdb):
    rng = random.Random(3)
    rows = [(rng.randrange(0, 300_000), i, f"h{i % 2}", float(rng.randrange(100)), rng.random() < 0.2) for i in range(60)]
    want = {}
    for some in by_key(rows).values():
        for k in range(len(some)):
            held = pd.Series([r[3] for r in some[: k + 1]][-7:])
            want[some[k][1]] = (len(held), *held.quantile([0.5, 0.95, 0.99]).tolist(), sum(r[4] for r in some[: k + 1]))
    got = streamed(spark, tmp_path, rows, "ts timestamp, id long, host string, latency double, error boolean", lambda s: P.in_order(s, ["host"], P.LatencyRing(7)))
    assert {r.id: pytest.approx((r.n, r.p50, r.p95, r.p99, r.errors)) for r in got} == want


def test_reviews(spark, tmp_path, rocksdb):
    """Status sticks and blocks are counted to three, whatever order events come in."""
    rng = random.Random(4)
    rows = [(rng.randrange(0, 300) * 1000, i, f"f{rng.randrange(5)}", rng.choice(["seen", "seen", "gone", "defer", "other"] + ["stop"] * 14)) for i in range(90)]
    want = {}
    for some in by_key(rows).values():
        state = ("new", 0)
        for _, i, _, event in some:
            after = P.review(state, event)
            want[i] = (*after, event == "stop" and after[1] > state[1])
            state = after
    got = streamed(spark, tmp_path, rows, "ts timestamp, id long, finding string, event string", lambda s: P.in_order(s, ["finding"], P.Reviews()))
    assert {r.id: (r.status, r.blocks, r.blocked) for r in got} == want
    assert {s for s, _, _ in want.values()} >= {"open", "deferred", "resolved", "escalated"}


def brute_cache(rows, sessions, files, ttl):
    """The store as an ordered dictionary of ordered dictionaries."""
    held, out = collections.OrderedDict(), {}
    for ms, i, _, session, path, kind, baseline in rows:
        if kind == "read":
            for old in [s for s, (written, _) in held.items() if written < ms - ttl]:
                del held[old]
            out[i] = None
            if session in held:
                held.move_to_end(session)
                out[i] = held[session][1].get(path)
            continue
        paths = held.get(session, (0, {}))[1]
        held[session] = (ms, paths)
        held.move_to_end(session)
        paths.setdefault(path, baseline)
        while len(held) > sessions:
            held.popitem(last=False)
        if len(paths) > files:
            del paths[next(p for p in paths if p != path)]
        out[i] = None
    return out


def test_baseline_cache(spark, tmp_path, rocksdb):
    """Least recently used sessions, oldest paths and old sessions go; the first baseline of a path stays."""
    rng = random.Random(5)
    rows = [(rng.randrange(0, 400) * 1000, i, "p", f"s{rng.randrange(5)}", f"f{rng.randrange(4)}", rng.choice(["read", "write", "write"]), [float(i)]) for i in range(150)]
    want = brute_cache(sorted(rows, key=lambda r: (r[0], r[1])), 3, 2, 60_000)
    got = streamed(spark, tmp_path, rows, "ts timestamp, id long, project string, session string, path string, kind string, baseline array<double>", lambda s: P.in_order(s, ["project"], P.BaselineCache(3, 2, 60_000)))
    assert {r.id: r.baseline for r in got} == want
    reads = [want[r[1]] for r in rows if r[5] == "read"]
    assert any(x is None for x in reads) and any(x is not None for x in reads) and not math.isnan(sum(x[0] for x in reads if x))
