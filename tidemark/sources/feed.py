"""The event feed: named endpoints, where to resume, and its lines as files."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import scalars


@dataclass(frozen=True)
class Feed:
    """What a collection run is about.  duration: as ``parse_duration`` reads it; none means until the input ends."""

    endpoint: str
    folder: str
    width: int = 60
    duration: str | None = None
    resume_gap_s: float = 2.0
    endpoints: tuple[tuple[str, str], ...] = ()

    def address(self) -> str:
        """The endpoint's address; one that is an address already stays."""
        if "://" in self.endpoint:
            return self.endpoint
        known = dict(self.endpoints)
        if self.endpoint not in known:
            raise ValueError(f"unknown endpoint {self.endpoint!r}; known: {sorted(known)}")
        return known[self.endpoint]

    def resumed(self, cursor_us: int | None) -> str:
        """The address from just after a cursor (cursors include their own event)."""
        return self.address() if cursor_us is None else f"{self.address()}{'&' if '?' in self.address() else '?'}cursor={cursor_us + 1}"

    def seconds(self) -> float | None:
        return scalars.parse_duration(self.duration) if self.duration else None


def replay(events: DataFrame, cursor_us: int | None) -> DataFrame:
    """The events after a cursor."""
    return events if cursor_us is None else events.where(F.col("time_us") > cursor_us)


def resume_gap(events: DataFrame, cursor_us: int, threshold_s: float = 2.0) -> DataFrame:
    """One row if the first event after a cursor is too late: (gap_from, gap_to) in microseconds."""
    first = replay(events, cursor_us).agg(F.min("time_us").alias("gap_to"))
    return first.select(F.lit(cursor_us).alias("gap_from"), "gap_to").where(F.col("gap_to") - F.col("gap_from") > int(threshold_s * scalars.MICROS))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder)


def line_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """(value, arrival) of the lines of files as they appear; files are small (a feed closes one every few seconds), and
    the order of arrival is that of the files' times and of the lines within a file."""
    whole = spark.readStream.option("maxFilesPerTrigger", files).option("wholetext", True).text(folder)
    placed = whole.select(F.unix_millis("_metadata.file_modification_time").alias("at"), F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    return placed.where("value <> ''").select("value", (F.col("at") * 1_000_000 + F.col("pos")).alias("arrival"))


def written(frames: list[tuple[int | None, str]], position: int = -1) -> list[tuple[int, str]]:
    """Frames (time_us or null, line) in the order of the stream with their positions: the greatest time so far."""
    out = []
    for us, line in frames:
        position = max(position, -1 if us is None else us)
        out.append((position, line))
    return out


def write_frames(lines: DataFrame, folder: str, *, order: list[str], value: str = "value") -> int:
    """Records lines as files that ``frames`` reads, and gives the number of files; ``order``: columns, the first the position.

    Each range of positions is a file, written where it is sorted; a task that runs again writes the same file anew.
    """

    def write(batches):
        from pyarrow import fs

        out = None
        for batch in batches:
            if out is None and batch.num_rows:
                store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{batch.column(0)[0].as_py():020d}.jsonl")
            if batch.num_rows:
                out.write(("\n".join(batch.column(1).to_pylist()) + "\n").encode())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([1])], ["files"])

    dealt = lines.repartitionByRange(order[0]).sortWithinPartitions(*order)
    return dealt.select(order[0], value).mapInArrow(write, "files long").count()


@dataclass
class Stretch(InputPartition):
    """Lines of one file with positions after ``start`` up to ``end``."""

    path: str
    first: int
    start: int
    end: int


#: Lines of one position that keep their order, and lines that are handed over together.
TIES, BATCH = 4096, 10_000


class FrameReader(DataSourceStreamReader):
    """Recorded frames as a stream whose offset is the feed's own cursor.

    A file holds what was received from one position on, and is named by it (20 digits); it begins with a line that moves the
    position on, so lines of one position are in one file.  A line's position is the greatest event time up to it, so an offset can stand behind any event, in the middle of a file, and reading goes on at the cursor
    plus one.  Offsets carry the endpoint; those of another one are refused.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.endpoint = options["path"], options.get("endpoint", "")
        self.cursor, self.until = int(options.get("cursor", -1)), int(options["until"]) if "until" in options else None

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))

    def _files(self) -> list[tuple[int, str]]:
        """(first position, path) of the files, in order."""
        from pyarrow import fs

        store, path = self._store()
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = [(f.base_name.split(".")[0], f.path) for f in found if f.is_file]
        return sorted((int(name), at) for name, at in names if name.isdigit())

    def _lines(self, path: str, first: int):
        """(position, line) of a file."""
        store, _ = self._store()
        position = first
        with store.open_input_stream(path) as raw:
            rest = b""
            while True:
                part = raw.read(1 << 20)
                *whole, rest = (rest + part).split(b"\n")
                if not part and rest:
                    whole.append(rest)
                for line in whole:
                    if line:
                        try:
                            us = json.loads(line).get("time_us")
                        except (ValueError, AttributeError):
                            us = None
                        position = max(position, us) if type(us) is int and us > 0 else position
                        yield position, line.decode("utf-8", "replace")
                if not part:
                    return

    def initialOffset(self) -> dict:
        return {"endpoint": self.endpoint, "cursor": self.cursor}

    def latestOffset(self) -> dict:
        """The last position there is; only the last file is read for it."""
        files, last = self._files(), self.cursor
        if files:
            last = max(last, files[-1][0], *(p for p, _ in self._lines(files[-1][1], files[-1][0])))
        return {"endpoint": self.endpoint, "cursor": last if self.until is None else min(last, max(self.until, self.cursor))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        if {start["endpoint"], end["endpoint"]} != {self.endpoint}:
            raise ValueError(f"an offset of {start['endpoint']!r} cannot go on at {self.endpoint!r}")
        if end["cursor"] < start["cursor"]:
            raise ValueError(f"the stream stands at {start['cursor']} already, beyond {end['cursor']}")
        files = self._files()
        nexts = [first for first, _ in files[1:]] + [None]
        lo, hi = start["cursor"], end["cursor"]
        return [Stretch(path, first, lo, hi) for (first, path), after in zip(files, nexts, strict=True) if first <= hi and (after is None or after > lo)]

    def read(self, partition: Stretch):
        ties, at, rows = 0, None, []
        for position, line in self._lines(partition.path, partition.first):
            ties = ties + 1 if position == at else 0
            at = position
            if position > partition.end:
                break
            if position > partition.start:
                rows.append((line, position, position * TIES + min(ties, TIES - 1)))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        value, position, arrival = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(value, pa.string()), pa.array(position, pa.int64()), pa.array(arrival, pa.int64())], ["value", "position_us", "arrival"])

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """Format ``recorded_frames``: path, endpoint, and optionally cursor (where a new stream begins) and until (where it
    ends; never before where a stream that goes on stands)."""

    @classmethod
    def name(cls) -> str:
        return "recorded_frames"

    def schema(self) -> str:
        return "value string, position_us long, arrival long"

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def frames(spark: SparkSession, folder: str, endpoint: str, *, cursor_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """(value, position_us, arrival) of recorded frames as a stream, from just after a cursor, up to a position.

    A stream that has a checkpoint goes on from there, whatever the cursor.  Each file is read by a task of its own, only as far
    as the batch goes; the driver lists files and reads the last one's times.
    """
    spark.dataSource.register(FrameSource)
    options = {"endpoint": endpoint} | ({} if cursor_us is None else {"cursor": str(cursor_us)}) | ({} if until_us is None else {"until": str(until_us)})
    return spark.readStream.format("recorded_frames").options(**options).load(folder)
