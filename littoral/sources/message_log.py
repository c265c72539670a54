"""A message log in a shared folder as a streaming source: partitions, offsets, and commits of consumer groups.

Messages of a partition lie in segments whose names tell the first offset and the number of messages, so offsets are
known from a listing alone and segments are never changed. A consumer's place is in its query's checkpoint; what it has
finished is also written beside the log, which is what lag is measured by. Delivery is at least once: a batch that
fails is read again, with the same offsets.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "id long, part int, place long, topic string, payload string"
_SEGMENT = re.compile(r"^(\d{20})-(\d+)\.jsonl$")
_STEP = 1 << 40  # ids are part * _STEP + place


def segments(path: str, part: int) -> list[tuple[int, int, str]]:
    """(first offset, number of messages, file) of a partition, in order."""
    folder = f"{path}/part={part}"
    names = os.listdir(folder) if os.path.isdir(folder) else ()
    return sorted((int(m[1]), int(m[2]), f"{folder}/{name}") for name in names if (m := _SEGMENT.match(name)))


def parts(path: str) -> list[int]:
    return sorted(int(name[5:]) for name in os.listdir(path) if re.fullmatch(r"part=\d+", name)) if os.path.isdir(path) else []


def high_marks(path: str) -> dict[str, int]:
    """The offset after the last message of each partition."""
    return {str(p): max((first + n for first, n, _ in segments(path, p)), default=0) for p in parts(path)}


def append(rows: DataFrame, path: str, n_parts: int, key: str = "topic") -> None:
    """Appends rows (topic, payload) to the partitions that their key chooses, one segment each. One writer at a time. A
    task that runs again writes the same segment, so its messages aren't doubled. Messages stream into their files."""
    marks = high_marks(path)
    part = F.pmod(F.xxhash64(key), F.lit(n_parts)).cast("int")

    def finish(p: int, out, temporary: str, n: int) -> None:
        out.close()
        os.replace(temporary, f"{path}/part={p}/{marks.get(str(p), 0):020d}-{n}.jsonl")

    def write(frames):
        now, out, temporary, n = None, None, "", 0
        for pdf in frames:  # sorted by partition, which may go on in the next frame
            for p, group in pdf.groupby("part", sort=True):
                if p != now:
                    if out:
                        finish(now, out, temporary, n)
                    os.makedirs(f"{path}/part={p}", exist_ok=True)
                    now, temporary, n = p, f"{path}/part={p}/.{uuid.uuid4().hex}", 0
                    out = open(temporary, "w")
                out.writelines(json.dumps({"topic": t, "payload": x}) + "\n" for t, x in zip(group["topic"], group["payload"]))
                n += len(group)
        if out:
            finish(now, out, temporary, n)
        yield from ()

    parted = rows.select(part.alias("part"), "topic", "payload").repartition(n_parts, "part").sortWithinPartitions("part")
    parted.mapInPandas(write, "part int").count()


def matches(wanted: str, topic: str) -> bool:
    """Whether a topic fits a filter in which + stands for one level and a last # for any number of them."""
    want, have = wanted.split("/"), topic.split("/")
    if want[-1] == "#":
        want, have = want[:-1], have[: len(want) - 1]
    return len(want) == len(have) and all(w in ("+", h) for w, h in zip(want, have))


def committed(path: str, group: str) -> dict[str, int]:
    try:
        with open(f"{path}/groups/{group}.json") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def lag(path: str, group: str) -> int:
    """Messages that a group hasn't finished, over all partitions; 0 where that can't be told."""
    try:
        done = committed(path, group)
        return sum(max(0, mark - done.get(p, 0)) for p, mark in high_marks(path).items())
    except (OSError, ValueError):
        return 0


@dataclass
class Stretch(InputPartition):
    part: int
    start: int
    end: int


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.group, self.filter = options["path"], options.get("group", "default"), options.get("filter", "#")
        self.rows = int(options.get("rowsPerTask", 100_000))

    def initialOffset(self) -> dict:
        return {str(p): 0 for p in parts(self.path)}

    def latestOffset(self) -> dict:
        return high_marks(self.path)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for p, stop in end.items():
            for at in range(start.get(p, 0), stop, self.rows):
                out.append(Stretch(int(p), at, min(stop, at + self.rows)))
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for first, n, file in segments(self.path, partition.part):
            lo, hi = max(first, partition.start), min(first + n, partition.end)
            if lo >= hi:
                continue
            places, topics, payloads = [], [], []
            with open(file) as lines:
                for k, line in enumerate(lines, first):
                    if k >= hi:
                        break
                    if k >= lo and matches(self.filter, (message := json.loads(line))["topic"]):
                        places.append(k)
                        topics.append(message["topic"])
                        payloads.append(message["payload"])
            ids = [partition.part * _STEP + k for k in places]
            columns = [pa.array(ids, pa.int64()), pa.array([partition.part] * len(ids), pa.int32()), pa.array(places, pa.int64()), pa.array(topics, pa.string()), pa.array(payloads, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "place", "topic", "payload"])

    def commit(self, end: dict) -> None:
        os.makedirs(f"{self.path}/groups", exist_ok=True)
        temporary = f"{self.path}/groups/.{uuid.uuid4().hex}"
        with open(temporary, "w") as out:
            json.dump(end, out)
        os.replace(temporary, f"{self.path}/groups/{self.group}.json")


class MessageLog(DataSource):
    """Options: path (a folder that the driver and all executors share), group, filter (of topics), rowsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def subscribe(spark: SparkSession, path: str, group: str, topics: str = "#", **options: str) -> DataFrame:
    """Messages (id, part, place, topic, payload) whose topic fits the filter, from the group's checkpoint on."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format("message_log").options(path=path, group=group, filter=topics, **options).load()
