"""The decision log as a data source of Spark: batch and stream, reading and writing.

A log is a folder of day folders (YYYY-MM-DD) with a file or more a session,
`<session>.jsonl`, packed as `<session>.jsonl.gz` once the day is over. Rows are
day, session, file and line; lines are parsed by Spark (parsed). Files are
reached through Arrow's file systems, so that folders may be local or in any
store that those reach.

    register(spark)
    spark.read.format("decision_log").load(root).where("day = '2024-03-05' AND session = 's1'")

Filters on day and session choose folders and files before anything in them is
listed or read. Options: `days` (that many folders, today's last), `since` (`14d`,
`36h` or `14`: folders from the start of the day that is that long ago), `now`
(an ISO time, to reckon from; else the clock, in UTC), `plain` (no packed files).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ledgerline.sources.logs import DECISIONS

SCHEMA = "day date, session string, file string, line string"
#: bytes of plain files that a task reads, of lines in a batch, and days after which the stream closes a folder
SLICE, BATCH, OPEN_DAYS = 64 << 20, 4 << 20, 2
STAGING = "_staging"


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _day(name: str) -> date | None:
    try:
        return date.fromisoformat(name) if len(name) == 10 else None
    except ValueError:
        return None


def _now(options: dict) -> datetime:
    now = options.get("now")
    when = datetime.fromisoformat(now) if now else datetime.now(UTC)
    return when if when.tzinfo else when.replace(tzinfo=UTC)


def first_day(options: dict) -> tuple[date | None, date | None]:
    """The first day that is read and, with `days`, the last."""
    now = _now(options).astimezone(UTC)
    if "days" in options:
        return now.date() - timedelta(days=max(1, int(options["days"])) - 1), now.date()
    if "since" not in options:
        return None, None
    spec = options["since"].strip().lower()
    span = timedelta(hours=int(spec[:-1])) if spec.endswith("h") else timedelta(days=int(spec.removesuffix("d")))
    return (now - span).date(), None


def session_of(name: str) -> str:
    """The session of a file; what follows a + says which write it came from."""
    return unquote(name.removesuffix(".gz").removesuffix(".jsonl").split("+")[0])


@dataclass
class LogSlice(InputPartition):
    """Files of a day, each with the bytes (start, end) that are wanted; an end of None is the file's."""

    day: date
    files: list = field(default_factory=list)


def _lines(store: pafs.FileSystem, path: str, start: int, end: int | None) -> Iterator[list[bytes]]:
    """The lines that begin in [start, end) of the unpacked file, in batches. A last line without an end counts."""
    packed = path.endswith(".gz")
    with store.open_input_stream(path, compression="gzip") if packed else store.open_input_file(path) as f:
        at = max(0, start - 1)
        if packed:
            left = at
            while left and (skipped := f.read(min(left, BATCH))):
                left -= len(skipped)
        else:
            f.seek(at)
        rest = b""
        if start:  # a line that began before belongs to the slice before
            while (chunk := f.read(BATCH)) and b"\n" not in chunk:
                at += len(chunk)
            cut = chunk.find(b"\n") + 1
            at, rest = at + cut, chunk[cut:]
            if not chunk:
                return
        while end is None or at < end:
            chunk = f.read(BATCH)
            rest += chunk
            lines = rest.split(b"\n")
            rest = lines.pop() if chunk else b""
            out = []
            for line in lines:
                if end is not None and at >= end:
                    break
                out.append(line)
                at += len(line) + 1
            yield out
            if not chunk:
                return


def _batch(part: LogSlice, path: str, lines: list[bytes]) -> pa.RecordBatch | None:
    texts = [t for x in lines if (t := x.decode("utf-8", "replace").strip())]
    if not texts:
        return None
    name, n = path.rsplit("/", 1)[1], len(texts)
    return pa.RecordBatch.from_arrays([pa.array([part.day] * n, pa.date32()), pa.array([session_of(name)] * n), pa.array([name] * n), pa.array(texts)], ["day", "session", "file", "line"])


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.first, self.last = first_day(self.options)
        self.days: set | None = None
        self.sessions: set | None = None

    def pushFilters(self, filters):
        """Takes equalities, sets and bounds on day and session; the rest is Spark's."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if isinstance(f, IsNotNull) and column in (("day",), ("session",)):
                continue  # neither is ever null
            if column == ("day",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.days = wanted if self.days is None else self.days & wanted
            elif column == ("day",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and value is not None:
                least = value + timedelta(days=isinstance(f, GreaterThan))
                self.first = least if self.first is None else max(self.first, least)
            elif column == ("day",) and isinstance(f, (LessThan, LessThanOrEqual)) and value is not None:
                most = value - timedelta(days=isinstance(f, LessThan))
                self.last = most if self.last is None else min(self.last, most)
            elif column == ("session",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.sessions = wanted if self.sessions is None else self.sessions & wanted
            else:
                yield f

    def _wanted(self, day: date) -> bool:
        return (self.days is None or day in self.days) and (self.first is None or day >= self.first) and (self.last is None or day <= self.last)

    def folders(self) -> list[tuple[date, str]]:
        """The wanted day folders that are there."""
        store, base = _store(self.options["path"])
        if self.days is not None:  # named: looked for, without listing the log
            named = [(d, f"{base}/{d.isoformat()}") for d in sorted(d for d in self.days if d is not None) if self._wanted(d)]
            return [(d, p) for (d, p), info in zip(named, store.get_file_info([p for _, p in named]), strict=True) if info.type == pafs.FileType.Directory]
        infos = store.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return sorted((d, i.path) for i in infos if i.type == pafs.FileType.Directory and (d := _day(i.base_name)) is not None and self._wanted(d))

    def files(self, folder: str) -> list:
        """The wanted files of a folder, by name; a plain file goes before its packed copy, which is then left out."""
        store, _ = _store(self.options["path"])
        infos = sorted(store.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.base_name)
        names = {i.base_name for i in infos}
        endings = (".jsonl",) if str(self.options.get("plain", "")).lower() == "true" else (".jsonl", ".jsonl.gz")
        wanted = [i for i in infos if i.is_file and i.base_name.endswith(endings) and i.base_name.removesuffix(".gz") not in (names if i.base_name.endswith(".gz") else ())]
        return [i for i in wanted if self.sessions is None or session_of(i.base_name) in self.sessions]

    def partitions(self):
        """Slices of a day of SLICE bytes or one packed file more; large plain files are cut."""
        out = []
        for day, folder in self.folders():
            part, held = LogSlice(day), 0
            for info in self.files(folder):
                cuts = [(0, None)] if info.base_name.endswith(".gz") or info.size <= SLICE else [(k, k + SLICE) for k in range(0, info.size, SLICE)]
                for start, end in cuts:
                    if part.files and held + min(info.size, SLICE) > SLICE:
                        out.append(part)
                        part, held = LogSlice(day), 0
                    part.files.append((info.path, start, end))
                    held += min(info.size, SLICE)
            if part.files:
                out.append(part)
        return out or [LogSlice(date.min)]

    def read(self, partition):
        """Files that can't be opened or unpacked are passed over from there on, as the log's readers do."""
        store, _ = _store(self.options["path"])
        for path, start, end in partition.files:
            try:
                for lines in _lines(store, path, start, end):
                    if (batch := _batch(partition, path, lines)) is not None:
                        yield batch
            except OSError:
                continue


def _whole_lines(store: pafs.FileSystem, path: str, size: int) -> int:
    """Bytes up to the end of the last whole line."""
    with store.open_input_file(path) as f:
        while size > 0:
            start = max(0, size - BATCH)
            f.seek(start)
            if (cut := f.read(size - start).rfind(b"\n")) >= 0:
                return start + cut + 1
            size = start
    return 0


class LogStreamReader(DataSourceStreamReader):
    """Offsets are bytes by file, up to the last whole line, of the folders of
    the newest day and OPEN_DAYS before; older ones are taken to be finished, so
    that an offset doesn't grow with the log. Files that are packed while the
    stream runs go on under their plain name."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.unpacked: dict = {}

    def initialOffset(self):
        return {"open_from": "", "files": {}}

    def _size(self, store: pafs.FileSystem, info) -> int:
        if not info.base_name.endswith(".gz"):
            return _whole_lines(store, info.path, info.size)
        key = (info.path, info.size, info.mtime_ns)
        if key not in self.unpacked:
            with store.open_input_stream(info.path, compression="gzip") as f:
                self.unpacked[key] = sum(map(len, iter(lambda: f.read(BATCH), b"")))
        return self.unpacked[key]

    def latestOffset(self):
        reader = LogReader(self.options)
        folders = reader.folders()
        if not folders:
            return self.initialOffset()
        store, base = _store(self.options["path"])
        first = folders[-1][0] - timedelta(days=OPEN_DAYS)
        infos = [i for day, folder in folders if day >= first for i in reader.files(folder)]
        return {"open_from": first.isoformat(), "files": {i.path[len(base) + 1 :].removesuffix(".gz"): self._size(store, i) for i in infos}}

    def partitions(self, start, end):
        store, base = _store(self.options["path"])
        ranges = [(name, start["files"].get(name, 0), upto) for name, upto in end["files"].items()]
        reader = LogReader(self.options)
        for day, folder in reader.folders():
            if start["open_from"] <= day.isoformat() < end["open_from"]:
                for info in reader.files(folder):
                    name = info.path[len(base) + 1 :].removesuffix(".gz")
                    ranges.append((name, start["files"].get(name, 0), None))
        out = []
        for name, frm, upto in sorted(ranges, key=lambda r: r[0]):
            cuts = [(frm, None)] if upto is None else [(k, min(upto, k + SLICE)) for k in range(frm, upto, SLICE)]
            out += [LogSlice(date.fromisoformat(name.split("/")[0]), [(f"{base}/{name}", a, b)]) for a, b in cuts]
        return out

    def read(self, partition):
        store, _ = _store(self.options["path"])
        for path, start, end in partition.files:
            if store.get_file_info(path).type == pafs.FileType.NotFound:
                path += ".gz"
            for lines in _lines(store, path, start, end):
                if (batch := _batch(partition, path, lines)) is not None:
                    yield batch


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged: (staged path, path in the log)."""

    files: list


def _stage(root: str, write: str, part: str, rows) -> Written:
    """A file for each day and session of the rows, in the staging folder; the
    task's own names, so that a task that is tried again meets no other one."""
    store, base = _store(root)
    held, files = {}, []
    try:
        for row in rows:
            key = (row.day.isoformat(), row.session)
            if key not in held:
                name = f"{quote(row.session, safe='')}+{write}-{part}.jsonl"
                staged = f"{base}/{STAGING}/{write}/{part}-{uuid.uuid4().hex}/{len(held)}"
                store.create_dir(staged.rsplit("/", 1)[0], recursive=True)
                held[key] = store.open_output_stream(staged)
                files.append((staged, f"{base}/{key[0]}/{name}"))
            held[key].write(row.line.encode() + b"\n")
    finally:
        for f in held.values():
            f.close()
    return Written(files)


def _publish(root: str, write: str, messages) -> None:
    """Moves what was staged to its place, then the staging folder goes. Done
    again after a crash it goes on where it stopped: names are those of the write."""
    store, base = _store(root)
    for message in messages:
        for staged, final in message.files if message else []:
            if store.get_file_info(staged).type == pafs.FileType.File:
                store.create_dir(final.rsplit("/", 1)[0], recursive=True)
                store.move(staged, final)
    _discard(root, write)


def _discard(root: str, write: str) -> None:
    store, base = _store(root)
    if store.get_file_info(f"{base}/{STAGING}/{write}").type == pafs.FileType.Directory:
        store.delete_dir(f"{base}/{STAGING}/{write}")


def _part() -> str:
    from pyspark import TaskContext

    return f"{TaskContext.get().partitionId():05d}"


class LogWriter(DataSourceWriter):
    """Appends rows (day, session, line); nothing is seen of a write that fails."""

    def __init__(self, options: dict):
        self.root, self.name = options["path"], uuid.uuid4().hex[:12]

    def write(self, iterator):
        return _stage(self.root, self.name, _part(), iterator)

    def commit(self, messages):
        _publish(self.root, self.name, messages)

    def abort(self, messages):
        _discard(self.root, self.name)


class LogStreamWriter(DataSourceStreamWriter):
    """As LogWriter, a write a batch. Files are named by the stream (option `stream`)
    and the batch: a batch that is run again replaces its own files."""

    def __init__(self, options: dict):
        self.root, self.stream, self.write_id = options["path"], quote(options.get("stream", "stream"), safe=""), uuid.uuid4().hex[:12]

    def write(self, iterator):
        return _stage(self.root, self.write_id, _part(), iterator)

    def _named(self, messages, batch_id):
        for message in messages:
            if message:
                yield Written([(s, f.replace(f"+{self.write_id}-", f"+{self.stream}-{batch_id}-")) for s, f in message.files])

    def commit(self, messages, batchId):
        _publish(self.root, self.write_id, self._named(messages, batchId))

    def abort(self, messages, batchId):
        _discard(self.root, self.write_id)


class DecisionLog(DataSource):
    @classmethod
    def name(cls):
        return "decision_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LogReader(self.options)

    def streamReader(self, schema):
        return LogStreamReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a log is appended to")
        return LogWriter(self.options)

    def streamWriter(self, schema, overwrite):
        return LogStreamWriter(self.options)


def register(spark) -> None:
    """Makes the format known to the session, and lets Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DecisionLog)


def parsed(lines: DataFrame, schema: str = DECISIONS) -> DataFrame:
    """The lines' fields beside day and session's file; lines that aren't JSON are in `_corrupt`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return lines.select(F.from_json("line", schema, options).alias("row"), "day", F.col("session").alias("file_session")).select("row.*", "day", "file_session")


def as_lines(rows: DataFrame, day: str = "day", session: str = "session_id") -> DataFrame:
    """day, session, line of rows, for writing: a JSON object with its keys in order, nulls left out;
    a session's rows of a write come together. Rows without a day or a session are an error when written."""
    fields = sorted(c for c in rows.columns if c != day)
    lines = rows.select(F.col(day).cast("date").alias("day"), F.col(session).cast("string").alias("session"), F.to_json(F.struct(*fields)).alias("line"))
    return lines if rows.isStreaming else lines.repartition("day", "session")


@dataclass
class Rotated:
    packed: int = 0
    evicted: int = 0


def rotate(spark, root: str, now: str | None = None, keep_days: int | None = None, cap: int | None = None) -> Rotated:
    """Once a day: packs the plain files of all days but today's, deletes those
    last written over keep_days ago, then the oldest until the log is within
    cap bytes. A sentinel file keeps a second run that day from doing anything.

    Packing runs in tasks, a file each at a time: a packed file is written aside,
    moved to its name, and only then the plain one goes, so that a task that is
    lost leaves nothing half done. Where a packed file is there already, the
    plain one is left as it is.
    """
    from ledgerline.sources.logs import CAP_BYTES, KEEP_DAYS

    keep_days, cap = KEEP_DAYS if keep_days is None else keep_days, CAP_BYTES if cap is None else cap
    store, base = _store(root)
    when = _now({"now": now} if now else {}).astimezone(UTC)
    sentinel = f"{base}/.last_rotate_{when.date().isoformat()}"
    if store.get_file_info(sentinel).type != pafs.FileType.NotFound:
        return Rotated()
    reader = LogReader({"path": root})
    files = [i for _, folder in reader.folders() for i in store.get_file_info(pafs.FileSelector(folder)) if i.is_file]
    names = {i.path for i in files}
    plain = [i.path for i in files if i.path.endswith(".jsonl") and i.path + ".gz" not in names and f"/{when.date().isoformat()}/" not in i.path]

    def pack(batches):
        own, _ = _store(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                aside = f"{base}/{STAGING}/pack-{uuid.uuid4().hex}"
                own.create_dir(f"{base}/{STAGING}", recursive=True)
                with own.open_input_stream(path) as src, own.open_output_stream(aside, compression="gzip") as dst:
                    while chunk := src.read(BATCH):
                        dst.write(chunk)
                own.move(aside, path + ".gz")
                own.delete_file(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    done = 0
    if plain:
        tasks = min(len(plain), 4 * spark.sparkContext.defaultParallelism)
        paths = spark.createDataFrame([(p,) for p in plain], "path string").repartition(tasks)
        done = paths.mapInArrow(pack, "n long").agg(F.sum("n")).first()[0]
    left = [i for _, folder in reader.folders() for i in store.get_file_info(pafs.FileSelector(folder)) if i.is_file]
    old = when - timedelta(days=keep_days)
    order = sorted(left, key=lambda i: (i.mtime_ns, i.path))
    total = sum(i.size for i in order if i.mtime >= old)
    evicted = 0
    for info in order:
        if info.mtime < old or total > cap:
            total -= info.size if info.mtime >= old else 0
            store.delete_file(info.path)
            evicted += 1
    with store.open_output_stream(sentinel):
        pass
    return Rotated(done, evicted)
