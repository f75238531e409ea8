"""The log as a data source: what is listed and read, streams, writes that fail, rotation."""

import gzip
import os
from datetime import UTC, date, datetime

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains

from ledgerline.sources import log_source as L
from ledgerline.sources import logs


@pytest.fixture
def log(spark, tmp_path):
    L.register(spark)
    root = str(tmp_path / "log")
    for day in range(1, 7):
        for session in ("s1", "s2"):
            rows = [{"decision_id": f"d{day}{session}{k}", "session_id": session, "ts": f"2024-03-0{day}T0{k}:00:00Z", "latency_ms": k} for k in range(3)]
            logs.write_session(root, f"2024-03-0{day}", session, rows, packed=day < 3)
    with open(f"{root}/2024-03-05/s1.jsonl", "a") as f:
        f.write("not json\n\n   \n")
    os.makedirs(f"{root}/notaday")
    return root


def load(spark, root, **options):
    return spark.read.format("decision_log").options(**options).load(root)


def test_all_rows(spark, log):
    rows = L.parsed(load(spark, log))
    assert rows.count() == 37 and rows.where("_corrupt is not null").count() == 1
    assert rows.where("_corrupt is null").agg(F.countDistinct("decision_id")).first()[0] == 36
    old = logs.read_log(spark, log).where("decision_id is not null")
    assert sorted(map(tuple, rows.where("_corrupt is null").select("decision_id", "day", "latency_ms").collect())) == sorted(map(tuple, old.select("decision_id", "day", "latency_ms").collect()))
    assert load(spark, log + "/none").count() == 0


def test_filters_choose_folders_and_files(log, monkeypatch):
    """What the pushed filters leave is all that is listed."""
    listed = []
    real = L._store

    class Watched:
        def __init__(self, store):
            self.store = store

        def get_file_info(self, what):
            listed.append(what.base_dir if isinstance(what, pafs.FileSelector) else what)
            return self.store.get_file_info(what)

        def __getattr__(self, name):
            return getattr(self.store, name)

    monkeypatch.setattr(L, "_store", lambda root: (Watched(real(root)[0]), real(root)[1]))
    day = lambda d: date(2024, 3, d)
    cases = [
        ([EqualTo(("day",), day(4)), IsNotNull(("day",))], [4], []),
        ([In(("day",), (day(2), day(9), None))], [2], []),
        ([GreaterThan(("day",), day(2)), LessThanOrEqual(("day",), day(4))], [3, 4], []),
        ([EqualTo(("session",), "s2"), EqualTo(("day",), day(1)), StringContains(("line",), "x")], [1], ["line"]),
        ([EqualTo(("day",), day(1)), EqualTo(("day",), day(2))], [], []),
    ]
    for filters, days, rest in cases:
        reader = L.LogReader({"path": log})
        assert [f.attribute[0] for f in reader.pushFilters(filters)] == rest
        listed.clear()
        parts = [p for p in reader.partitions() if p.files]
        assert sorted({p.day.day for p in parts}) == days
        assert sorted({x for x in listed if isinstance(x, str) and "/2024-" in x}) == [f"{log}/2024-03-0{d}" for d in days]
        if EqualTo(("session",), "s2") in filters:
            assert [os.path.basename(f) for p in parts for f, _, _ in p.files] == ["s2.jsonl.gz"]


def test_filters_reach_the_source(spark, log):
    """A day that is not asked for isn't opened: here opening it would fail."""
    with open(f"{log}/2024-03-03/s3.jsonl.gz", "wb") as f:
        f.write(b"\x1f\x8bdamaged")
    got = load(spark, log).where("day = DATE '2024-03-04' AND session = 's1'")
    assert got.count() == 3 and {r.file for r in got.collect()} == {"s1.jsonl"}
    assert got.rdd.getNumPartitions() == 1 < load(spark, log).rdd.getNumPartitions() == 6
    assert load(spark, log).where("day >= DATE '2024-03-05' AND line LIKE '%d61%'").count() == 0
    assert load(spark, log).count() == 37  # a damaged file is passed over


def test_windows(spark, log):
    """`days` counts folders, `since` goes back to the start of a day, `plain` leaves packed files out."""
    days = lambda **o: sorted({r.day.day for r in load(spark, log, **o).select("day").collect()})
    assert days(days="2", now="2024-03-05T23:00:00Z") == [4, 5]
    assert days(since="2d", now="2024-03-05T23:00:00Z") == [3, 4, 5, 6]
    assert days(since="2", now="2024-03-06T01:00:00+00:00") == [4, 5, 6]
    assert days(since="36h", now="2024-03-06T11:00:00Z") == [4, 5, 6] and days(since="36h", now="2024-03-06T12:00:00Z") == [5, 6]
    assert days(plain="true") == [3, 4, 5, 6]
    assert days(days="2", now="2024-03-05T23:00:00-05:00") == [5, 6]


def test_large_files_are_cut_at_lines(spark, log, monkeypatch, tmp_path):
    """Every line in exactly one slice, whatever the cuts."""
    path = tmp_path / "x.jsonl"
    lines = [b"%d" % k * (1 + k % 7) for k in range(200)] + [b"", b"last without end"]
    path.write_bytes(b"\n".join(lines))
    size = path.stat().st_size
    store, _ = L._store(str(tmp_path))
    for batch in (5, 64):
        monkeypatch.setattr(L, "BATCH", batch)
        for step in (1, 7, 50, 10_000):
            got = [x for k in range(0, size, step) for part in L._lines(store, str(path), k, k + step) for x in part]
            assert [x for x in got if x] == [x for x in lines if x]
    packed = tmp_path / "x.jsonl.gz"
    packed.write_bytes(gzip.compress(path.read_bytes()))
    assert [x for p in L._lines(store, str(packed), 0, None) for x in p][-1] == b"last without end"


def test_writes_are_seen_whole_or_not_at_all(spark, tmp_path):
    L.register(spark)
    root = str(tmp_path / "out")
    os.makedirs(root)
    rows = spark.createDataFrame([(date(2024, 3, 1 + k % 2), f"s/{k % 3}", k, None if k % 2 else "é") for k in range(12)], "day date, session_id string, n long, note string")
    L.as_lines(rows).write.format("decision_log").mode("append").save(root)
    back = L.parsed(load(spark, root), "n long, note string, session_id string")
    assert sorted((r.n, r.note, r.session_id, r.file_session) for r in back.collect()) == [(k, None if k % 2 else "é", f"s/{k % 3}", f"s/{k % 3}") for k in range(12)]
    assert load(spark, root).where("session = 's/1'").count() == 4
    assert sorted(os.listdir(root)) in (["2024-03-01", "2024-03-02"], ["2024-03-01", "2024-03-02", L.STAGING]) and not any(f for _, _, f in os.walk(f"{root}/{L.STAGING}"))
    line = next(r.line for r in load(spark, root).collect() if '"n":4' in r.line)
    assert line == '{"n":4,"note":"é","session_id":"s/1"}'
    before = {p: os.stat(p).st_mtime_ns for d, _, fs in os.walk(root) for p in (os.path.join(d, f) for f in fs)}
    bad = L.as_lines(rows).withColumn("line", F.when(F.col("session") == "s/2", F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("decision_log").mode("append").save(root)
    assert {p: os.stat(p).st_mtime_ns for d, _, fs in os.walk(root) for p in (os.path.join(d, f) for f in fs)} == before
    with pytest.raises(Exception, match="appended"):
        L.as_lines(rows).write.format("decision_log").mode("overwrite").save(root)


def run(spark, root, out, check):
    stream = spark.readStream.format("decision_log").load(root)
    query = stream.select("day", "session", "line").writeStream.format("decision_log").option("path", out).option("stream", "copy").option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_streams_go_on_where_they_stopped(spark, log, tmp_path):
    """New lines, new files, a half-written line, files packed in between, days that are closed."""
    out, check = str(tmp_path / "copy"), str(tmp_path / "check")
    os.makedirs(out)
    copied = lambda: sorted(r.line for r in load(spark, out).collect())
    run(spark, log, out, check)
    want = sorted(r.line for r in load(spark, log).collect())
    assert copied() == want and len(want) == 37
    run(spark, log, out, check)
    assert copied() == want  # nothing new, nothing twice
    with open(f"{log}/2024-03-06/s1.jsonl", "a") as f:
        f.write('{"decision_id":"new"}\n{"decision_id":"half')
    logs.write_session(log, "2024-03-06", "s9", [{"decision_id": "other"}])
    run(spark, log, out, check)
    assert copied() == sorted([*want, '{"decision_id":"new"}', '{"decision_id": "other"}'])
    with open(f"{log}/2024-03-06/s1.jsonl", "a") as f:
        f.write('"}\n')
    L.rotate(spark, log, now="2024-03-09T00:00:00Z", keep_days=10**5)
    assert sorted(os.listdir(f"{log}/2024-03-06")) == ["s1.jsonl.gz", "s2.jsonl.gz", "s9.jsonl.gz"]
    logs.write_session(log, "2024-03-09", "s1", [{"decision_id": "later"}])
    run(spark, log, out, check)
    assert copied() == sorted([*want, '{"decision_id":"new"}', '{"decision_id": "other"}', '{"decision_id":"half"}', '{"decision_id": "later"}'])
    assert set(L.LogStreamReader({"path": log}).latestOffset()["files"]) == {"2024-03-09/s1.jsonl"}


def test_a_batch_run_again_replaces_its_files(tmp_path):
    root = str(tmp_path)
    from pyspark.sql import Row

    for attempt in range(2):
        writer = L.LogStreamWriter({"path": root, "stream": "a"})
        message = L._stage(root, writer.write_id, "00003", [Row(day=date(2024, 3, 1), session="s", line=f"{k}") for k in range(3)])
        assert not os.path.exists(f"{root}/2024-03-01") or attempt
        writer.commit([message, None], 7)
        assert os.listdir(f"{root}/2024-03-01") == ["s+a-7-00003.jsonl"]
    lost = L.LogStreamWriter({"path": root, "stream": "a"})
    L._stage(root, lost.write_id, "00000", [Row(day=date(2024, 3, 1), session="t", line="x")])
    lost.abort([], 8)
    assert os.listdir(f"{root}/2024-03-01") == ["s+a-7-00003.jsonl"] and not any(f for _, _, f in os.walk(f"{root}/{L.STAGING}"))


def test_rotation(spark, log):
    now = datetime(2024, 3, 6, 12, tzinfo=UTC)
    for day in range(1, 7):
        for f in os.listdir(f"{log}/2024-03-0{day}"):
            stamp = datetime(2024, 3, day, 1, tzinfo=UTC).timestamp()
            os.utime(f"{log}/2024-03-0{day}/{f}", (stamp, stamp))
    with open(f"{log}/2024-03-04/s1.jsonl.gz", "wb") as f:
        f.write(gzip.compress(b"{}\n"))
    want = sorted(r.line for r in load(spark, log).where("day > DATE '2024-03-02'").collect())
    done = L.rotate(spark, log, now.isoformat(), keep_days=4)
    assert (done.packed, done.evicted) == (5, 4)  # the packed files of days 1 and 2 were written too long ago
    assert sorted(os.listdir(f"{log}/2024-03-04")) == ["s1.jsonl", "s1.jsonl.gz", "s2.jsonl.gz"]  # left as it is
    assert sorted(os.listdir(f"{log}/2024-03-06")) == ["s1.jsonl", "s2.jsonl"]
    assert sorted(r.line for r in load(spark, log).collect()) == want
    state = sorted((p, os.stat(p).st_mtime_ns) for d, _, fs in os.walk(log) for p in (os.path.join(d, f) for f in fs))
    assert L.rotate(spark, log, now.isoformat(), keep_days=0, cap=0) == L.Rotated()  # once a day
    assert sorted((p, os.stat(p).st_mtime_ns) for d, _, fs in os.walk(log) for p in (os.path.join(d, f) for f in fs)) == state
    sizes = sorted((os.stat(p).st_mtime_ns, p, os.stat(p).st_size) for d, _, fs in os.walk(log) for p in (os.path.join(d, f) for f in fs) if "/2024-" in p)
    cap = sum(s for _, _, s in sizes[-3:])
    done = L.rotate(spark, log, "2024-03-07T00:00:00Z", keep_days=10**4, cap=cap)
    left = {p for d, _, fs in os.walk(log) for p in (os.path.join(d, f) for f in fs) if "/2024-" in p}
    assert done.packed == 2 and done.evicted >= 1 and sum(os.stat(p).st_size for p in left) <= cap and left
