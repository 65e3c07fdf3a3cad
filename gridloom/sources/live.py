"""Live frames of several streams: a Python data source for batch and Structured Streaming.

A recorder appends segments to a folder of its stream, ``<path>/stream=<id>/<segment>``: a file of JSON lines, or a folder of such files,
that appears as a whole and whose name sorts behind the earlier ones. A line has ``frame_no``, ``session`` (one for
each connection) and ``payload``. A stream's offset is the name of the last segment that was read, so a restarted query
goes on where its checkpoint ends and repeats nothing; each stream is a partition of its own.

Options: ``path``; ``keep`` is ``all`` (every frame) or ``latest`` (the last frame that a batch finds of each stream, with
the number of those it passed over). Where a session differs from the one before, a row with ``gap`` and without payload
stands in front of the frame: the stream was lost in between.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id string, frame_no long, session string, gap boolean, passed_over long, payload string"


@dataclass
class Stretch(InputPartition):
    """Segments of a stream behind ``after`` (None: from the first), up to ``upto``."""

    stream: str
    after: str | None
    upto: str


class Recording:
    """The folder of recorded streams, by way of whatever file system its address names."""

    def __init__(self, path: str):
        from pyarrow import fs

        at = path if "://" in path else path.removeprefix("file:")
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), at)
        self.root = self.root.rstrip("/")

    def _names(self, folder: str, kinds: tuple = ()) -> list[str]:
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(x.base_name for x in found if not x.base_name.startswith(("_", ".")) and (not kinds or x.type in kinds))

    def streams(self) -> list[str]:
        return [name.removeprefix("stream=") for name in self._names(self.root) if name.startswith("stream=")]

    def segments(self, stream: str) -> list[str]:
        return self._names(f"{self.root}/stream={stream}")

    def lines(self, stream: str, segment: str) -> Iterator[dict]:
        from pyarrow import fs

        at = f"{self.root}/stream={stream}/{segment}"
        inside = self.files.get_file_info(at).type == fs.FileType.Directory
        for name in [f"{at}/{x}" for x in self._names(at)] if inside else [at]:
            with self.files.open_input_stream(name) as raw:
                rest = b""
                while block := raw.read(1 << 20):
                    *whole, rest = (rest + block).split(b"\n")
                    yield from (json.loads(line) for line in whole if line.strip())
                if rest.strip():
                    yield json.loads(rest)

    def rows(self, part: Stretch, keep: str) -> Iterator[tuple]:
        segments = [s for s in self.segments(part.stream) if s <= part.upto]
        wanted = [s for s in segments if part.after is None or s > part.after]
        before = None
        if part.after in segments:  # the session that the last batch ended with
            for line in self.lines(part.stream, part.after):
                before = line.get("session")
        last, passed, lost = None, 0, False
        for segment in wanted:
            for line in self.lines(part.stream, segment):
                session = line.get("session")
                gap = before is not None and session != before
                before = session
                if keep == "all":
                    if gap:
                        yield self._gap(part.stream, line, 0)
                    yield self._frame(part.stream, line, 0)
                else:
                    passed, last, lost = passed + (last is not None), line, lost or gap
        if last is not None:
            if lost:
                yield self._gap(part.stream, last, 0)
            yield self._frame(part.stream, last, passed)

    @staticmethod
    def _gap(stream: str, line: dict, passed: int) -> tuple:
        return stream, line.get("frame_no"), line.get("session"), True, passed, None

    @staticmethod
    def _frame(stream: str, line: dict, passed: int) -> tuple:
        payload = line.get("payload")
        return stream, line.get("frame_no"), line.get("session"), False, passed, payload if payload is None or isinstance(payload, str) else json.dumps(payload)


class _Batch(DataSourceReader):
    def __init__(self, path: str, keep: str):
        self.path, self.keep = path, keep

    def partitions(self) -> list[Stretch]:
        found = Recording(self.path)
        return [Stretch(s, None, names[-1]) for s in found.streams() if (names := found.segments(s))]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return Recording(self.path).rows(partition, self.keep) if partition is not None else iter(())  # no stream yet: one part, none


class _Live(DataSourceStreamReader):
    def __init__(self, path: str, keep: str):
        self.path, self.keep = path, keep

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = Recording(self.path)
        return {s: names[-1] for s in found.streams() if (names := found.segments(s))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [Stretch(s, start.get(s), upto) for s, upto in sorted(end.items()) if start.get(s) is None or upto > start[s]]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return Recording(self.path).rows(partition, self.keep)


class LiveFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_frames"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, str]:
        path, keep = self.options.get("path"), self.options.get("keep", "all")
        if not path or keep not in ("all", "latest"):
            raise ValueError("live_frames needs a path, and keep is all or latest")
        return path, keep

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Live(*self._options())


def live_frames(spark: SparkSession, path: str, keep: str = "all", stream: bool = True):
    """The frames of the recordings below ``path``, as a streaming frame or as they are now."""
    spark.dataSource.register(LiveFrames)
    reader = spark.readStream if stream else spark.read
    return reader.format("live_frames").option("path", path).option("keep", keep).load()
