"""Topics kept as files in a shared folder: a Spark data source with partitions and offsets, where no broker is at hand."""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter,
                                    DataSourceStreamReader, InputPartition, WriterCommitMessage)

PARTITIONS = 8
ROWS_PER_TASK = 200_000
MESSAGE = pa.schema([("key", pa.string()), ("value", pa.string()), ("timestamp", pa.timestamp("us", "UTC"))])
EMPTY = {"partitions": None, "begins": {}, "ends": {}, "segments": [], "writers": {}}


class Log:
    """Segments of messages, and one numbered commit file per appended batch.

    A commit names its segments with their first offsets, and the offsets of every topic partition before and after it, so the newest
    one tells where the log ends and a range of offsets is found by bisection.
    """

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))

    def _put(self, name: str, body: dict) -> None:
        """Appears whole or not at all."""
        folder = f"{self.root}/{name.rpartition('/')[0]}"
        self.fs.create_dir(folder, recursive=True)
        part = f"{folder}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as out:
            out.write(json.dumps(body).encode())
        self.fs.move(part, f"{self.root}/{name}")

    def _get(self, name: str) -> dict | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as source:
                return json.loads(source.read())
        except FileNotFoundError:
            return None

    def size(self) -> int:
        """Number of commits."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return 1 + max((int(f.base_name) for f in found if f.base_name.isdigit()), default=-1)

    def commit(self, number: int) -> dict:
        return self._get(f"commits/{number:020d}") if number >= 0 else EMPTY

    def ends(self, topics: list[str] | None = None) -> dict[str, int]:
        ends = self.commit(self.size() - 1)["ends"]
        return {at: n for at, n in ends.items() if topics is None or at.rpartition("/")[0] in topics}

    def append(self, segments: list[tuple[str, str, int]], partitions: int, writer: str, batch: int) -> None:
        """Offsets for (topic partition, file, rows) in the given order. A batch that this writer committed before changes nothing."""
        number = self.size()
        last = self.commit(number - 1)
        if last["writers"].get(writer, -1) >= batch:
            return
        ends, placed = dict(last["ends"]), []
        for at, file, rows in segments:
            placed.append((at, ends.get(at, 0), rows, file))
            ends[at] = ends.get(at, 0) + rows
        self._put(f"commits/{number:020d}", {"partitions": partitions, "begins": last["ends"], "ends": ends, "segments": placed,
                                             "writers": {**last["writers"], writer: batch}})

    def spans(self, start: dict[str, int], end: dict[str, int]) -> list[tuple[str, int, str, int, int]]:
        """(topic partition, first offset, file, rows to skip, rows) of all messages from ``start`` on and before ``end``."""
        size, out = self.size(), []
        after = lambda n: any(self.commit(n)["ends"].get(at, 0) > start.get(at, 0) for at in end)
        for number in range(bisect.bisect_left(range(size), True, key=after), size):
            commit = self.commit(number)
            if all(commit["begins"].get(at, 0) >= n for at, n in end.items()):
                break
            for at, first, rows, file in commit["segments"]:
                low, high = max(first, start.get(at, 0)), min(first + rows, end.get(at, 0))
                if low < high:
                    out.append((at, low, file, low - first, high - low))
        return out

    def committed(self, group: str) -> dict[str, int] | None:
        return self._get(f"groups/{quote(group, safe='')}")

    def save_group(self, group: str, ends: dict[str, int]) -> None:
        self._put(f"groups/{quote(group, safe='')}", ends)


def tasks(spans: list[tuple], rows: int) -> list[InputPartition]:
    """Spans cut and packed so that a task reads at most ``rows`` messages."""
    out: list[list] = []
    room = 0
    for at, offset, file, skip, n in spans:
        while n:
            if not room:
                out.append([])
                room = rows
            take = min(n, room)
            out[-1].append((at, offset, file, skip, take))
            offset, skip, n, room = offset + take, skip + take, n - take, room - take
    return [InputPartition(spans) for spans in out]


class Segments:
    """Reading of spans, as batch and stream readers share it."""

    def __init__(self, options):
        self.path = options["path"]
        self.topics = [t.strip() for t in options["subscribe"].split(",")] if "subscribe" in options else None
        self.rows = int(options.get("rowsPerTask", ROWS_PER_TASK))

    def read(self, partition: InputPartition | None):
        log = Log(self.path)
        for at, offset, file, skip, rows in partition.value if partition else []:  # a table without partitions is read once
            topic, _, number = at.rpartition("/")
            with log.fs.open_input_file(f"{log.root}/{file}") as source:
                table = pq.ParquetFile(source)
                for group in range(table.num_row_groups):
                    size = table.metadata.row_group(group).num_rows
                    if skip >= size:
                        skip -= size
                        continue
                    if not rows:
                        break
                    part = table.read_row_group(group).slice(skip, rows)
                    for batch in part.to_batches():
                        n = batch.num_rows
                        yield pa.RecordBatch.from_arrays([
                            pa.array([topic] * n, pa.string()), pa.array(np.full(n, int(number), np.int32)),
                            pa.array(np.arange(offset, offset + n)), *batch.columns],
                            ["topic", "partition", "offset", *MESSAGE.names])
                        offset, rows = offset + n, rows - n
                    skip = 0


class BatchReader(Segments, DataSourceReader):
    def partitions(self):
        log = Log(self.path)
        return tasks(log.spans({}, log.ends(self.topics)), self.rows)


class StreamReader(Segments, DataSourceStreamReader):
    """Bounded batches need the position of the query. It is known from each planned batch; after a restart and before the first one,
    the offsets of the consumer group bound it from below."""

    def __init__(self, options):
        super().__init__(options)
        if self.topics is None:
            raise ValueError("a stream needs the option subscribe")
        self.group = options.get("group")
        self.from_start = options.get("startingOffsets", "latest") == "earliest"
        self.bound = int(options["maxOffsetsPerTrigger"]) if "maxOffsetsPerTrigger" in options else None
        if self.bound is not None and not self.group:
            raise ValueError("maxOffsetsPerTrigger needs the option group")
        self.position: dict[str, int] | None = None
        self.planned = False

    def initialOffset(self):
        log = Log(self.path)
        found = log.committed(self.group) if self.group else None
        if found is None:
            found = {} if self.from_start else log.ends(self.topics)
            if self.group:
                log.save_group(self.group, found)
        self.position = found
        return found

    def latestOffset(self):
        log = Log(self.path)
        ends = log.ends(self.topics)
        if self.bound is None:
            return ends
        if self.position is None:
            self.position = log.committed(self.group) or {}
        count = (log.commit(log.size() - 1)["partitions"] or 1) * len(self.topics)
        # An equal share for each partition: from a position below, the same log never gives an end below an earlier one.
        share = max(1, self.bound // count)
        upto = {at: min(n, self.position.get(at, 0) + share) for at, n in ends.items()}
        if not self.planned:
            self.position = upto
        return upto

    def partitions(self, start, end):
        if any(end.get(at, 0) < n for at, n in start.items()):
            raise ValueError(f"offsets run backwards, from {start} to {end}: the log or maxOffsetsPerTrigger became smaller")
        self.position, self.planned = end, True
        return tasks(Log(self.path).spans(start, end), self.rows)

    def commit(self, end):
        if self.group:
            Log(self.path).save_group(self.group, end)


class Appended(WriterCommitMessage):
    def __init__(self, segments):
        self.segments = segments


class Segmenter:
    """Writing of segments, as batch and stream writers share it. Files of an aborted or repeated batch are named by no commit."""

    def __init__(self, options):
        self.path = options["path"]
        self.count = int(options.get("numPartitions", PARTITIONS))
        self.writer = options.get("writer") or options.get("checkpointLocation")
        known = (log := Log(self.path)).commit(log.size() - 1)["partitions"]
        if known not in (None, self.count):
            raise ValueError(f"the log has {known} partitions a topic, not {self.count}")

    def write(self, iterator):
        log = Log(self.path)
        open_files: dict[str, list] = {}
        try:
            for batch in iterator:
                for at, part in self.dealt(batch):
                    if at not in open_files:
                        topic, _, number = at.rpartition("/")
                        name = f"segments/{quote(topic, safe='')}/{number}/{uuid.uuid4().hex}.parquet"
                        log.fs.create_dir(f"{log.root}/{name.rpartition('/')[0]}", recursive=True)
                        open_files[at] = [pq.ParquetWriter(f"{log.root}/{name}", MESSAGE, filesystem=log.fs), name, 0]
                    open_files[at][0].write_table(part)
                    open_files[at][2] += part.num_rows
        finally:
            for file, _, _ in open_files.values():
                file.close()
        return Appended([(at, name, rows) for at, (_, name, rows) in sorted(open_files.items())])

    def dealt(self, batch: pa.RecordBatch):
        """(topic partition, messages): a key always goes to one partition; without a key the value decides."""
        if not batch.num_rows:
            return
        table = pa.Table.from_batches([batch])
        if table["topic"].null_count:
            raise ValueError("a message without a topic")
        topics = table["topic"].combine_chunks().dictionary_encode()
        keys = pc.coalesce(table["key"].cast(pa.string()), table["value"].cast(pa.string()), "").combine_chunks().dictionary_encode()
        numbers = np.fromiter((zlib.crc32(k.encode("utf-8", "surrogatepass")) % self.count for k in keys.dictionary.to_pylist()),
                              np.int64, len(keys.dictionary))
        code = topics.indices.to_numpy().astype(np.int64) * self.count + numbers[keys.indices.to_numpy()]
        names = topics.dictionary.to_pylist()
        messages = table.select(MESSAGE.names).cast(MESSAGE)
        for c in np.unique(code):
            yield f"{names[c // self.count]}/{c % self.count}", messages.take(np.flatnonzero(code == c))

    def append(self, messages, batch: int) -> None:
        segments = [s for m in messages if m is not None for s in m.segments]
        Log(self.path).append(segments, self.count, self.writer, batch)


class BatchWriter(Segmenter, DataSourceArrowWriter):
    def __init__(self, options):
        super().__init__(options)
        self.writer = uuid.uuid4().hex

    def commit(self, messages):
        self.append(messages, 0)

    def abort(self, messages):
        """Nothing to undo: no commit names the files."""


class StreamWriter(Segmenter, DataSourceStreamArrowWriter):
    def __init__(self, options):
        super().__init__(options)
        if not self.writer:
            raise ValueError("a stream into a log needs the option writer or checkpointLocation")

    def commit(self, messages, batchId):
        self.append(messages, batchId)

    def abort(self, messages, batchId):
        """Nothing to undo: no commit names the files."""


class TopicLog(DataSource):
    """Messages (topic, partition, offset, key, value, timestamp) of a folder that all executors reach.

    Writing takes topic, key, value and timestamp by name, ignores further columns and fails on a null topic; a null key, value or time stays null.
    Offsets of a topic partition start at 0 and have no gaps. A batch that a stream repeats after a failure adds nothing. One query at a time
    may write to a log. ``numPartitions`` (8) is fixed by the first write.

    Reading as a table gives the whole log, or the topics of ``subscribe``. A stream needs ``subscribe`` (names joined by commas) and starts
    at the end of the log, or with ``startingOffsets`` ``earliest``, or where the consumer ``group`` stopped; later runs on the same checkpoint
    give each offset once. ``maxOffsetsPerTrigger`` is shared out equally to the partitions (one message each at least); with the trigger
    ``availableNow``, Spark then takes one such batch a run. A task reads at most ``rowsPerTask`` messages, whatever partition they are in.
    """

    @classmethod
    def name(cls):
        return "topic_log"

    def schema(self):
        return "topic string, partition int, offset bigint, key string, value string, timestamp timestamp"

    def reader(self, schema):
        return BatchReader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)

    def _checked(self, schema):
        missing = {"topic", *MESSAGE.names} - set(schema.names)
        if missing:
            raise ValueError(f"messages lack {sorted(missing)}")

    def writer(self, schema, overwrite):
        self._checked(schema)
        if overwrite:
            raise ValueError("a log is only appended to")
        return BatchWriter(self.options)

    def streamWriter(self, schema, overwrite):
        self._checked(schema)
        return StreamWriter(self.options)


def log_stream(spark: SparkSession, path: str, topics: list[str], **options) -> DataFrame:
    """The messages of ``topics`` as a stream."""
    spark.dataSource.register(TopicLog)
    return spark.readStream.format("topic_log").option("subscribe", ",".join(topics)).options(**options).load(path)


def log_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """All messages that are in the log now."""
    spark.dataSource.register(TopicLog)
    return spark.read.format("topic_log").options(**options).load(path)


def append_table(messages: DataFrame, path: str, **options) -> None:
    messages.sparkSession.dataSource.register(TopicLog)
    messages.write.format("topic_log").mode("append").options(**options).save(path)


def log_writer(messages: DataFrame, path: str, checkpoint: str, **options):
    """A stream writer into the log; the caller sets a trigger and starts it."""
    messages.sparkSession.dataSource.register(TopicLog)
    return messages.writeStream.format("topic_log").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).options(**options)
