"""Append-only logs of lines as a Spark data source, for batches and for streams: a folder of files, each a line a message.

    spark.dataSource.register(MessageLog)
    spark.read.format("message_log").load(folder)
    spark.readStream.format("message_log").option("maxBytesPerTrigger", "64m").load(folder)

Rows are (file, at, value): where a line stands and the line. Files are cut into ranges of ``splitBytes``; a range owns the lines that begin
in it, so a file of any size is read by many tasks and no line is read twice. A stream's offset says how far each file has been read, always up
to the end of a line: a line that is still being written waits. What lies between two offsets is always the same lines, so a batch
that is run again after a failure reads what it read before. ``maxBytesPerTrigger`` admits so much a batch, the files in their order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, value string"
SPLIT, STEP = 32 << 20, 1 << 16
#: Where a stream notes what it has planned, so that a restarted one knows where to go on admitting. Spark's own log decides what is read.
NOTE = "_planned.json"


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def number(text: str) -> int:
    """Bytes of '64m', '10k' or '123'."""
    unit = {"k": 10, "m": 20, "g": 30}.get(text[-1].lower())
    return int(text[:-1]) << unit if unit else int(text)


class _Folder:
    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))}

    def line_end(self, file: str, start: int, wanted: int, size: int) -> int:
        """The end of the last line that ends between start and wanted; of the first one after it, where none does; start if no line is whole."""
        with self.files.open_input_file(file) as f:
            at = wanted
            while at > start:
                low = max(start, at - STEP)
                if (found := f.read_at(at - low, low).rfind(b"\n")) >= 0:
                    return low + found + 1
                at = low
            at = wanted
            while at < size:
                held = f.read_at(min(STEP, size - at), at)
                if (found := held.find(b"\n")) >= 0:
                    return at + found + 1
                at += len(held)
        return start


def ranges(file: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(file, a, min(a + split, end)) for a in range(start, end, split)]


def lines(folder: str, part: Range, whole: bool) -> Iterator:
    """Batches of the lines that begin in the range. whole: the range begins at a line's begin and ends at a line's end."""
    import pyarrow as pa

    held = _Folder(folder)
    with held.files.open_input_file(part.file) as f:
        size, at = f.size(), part.start
        if not whole and at:  # the line that reaches into the range is its predecessor's
            at -= 1
            while at < size:
                chunk = f.read_at(STEP, at)
                if (k := chunk.find(b"\n")) >= 0:
                    at += k + 1
                    break
                at += len(chunk)
        rest, begin = b"", at
        while begin < part.end:
            chunk = f.read_at(min(1 << 20, size - at), at) if at < size else b""
            at += len(chunk)
            pieces = (rest + chunk).split(b"\n")
            rest = pieces.pop()
            if not chunk and rest:
                pieces, rest = [rest], b""
            files, places, values = [], [], []
            for piece in pieces:
                if begin < part.end:
                    files.append(part.file)
                    places.append(begin)
                    values.append(piece.decode(errors="replace"))
                begin += len(piece) + 1
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], names=["file", "at", "value"])
            if not chunk:
                break


class _Reader(DataSourceReader):
    def __init__(self, folder: str, split: int):
        self.folder, self.split = folder, split

    def partitions(self) -> list[Range]:
        found = [r for file, size in _Folder(self.folder).sizes().items() for r in ranges(file, 0, size, self.split)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator:
        return lines(self.folder, partition, whole=False) if partition.file else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, split: int, most: int | None):
        self.folder, self.split, self.most, self.last = folder, split, most, None

    def initialOffset(self) -> dict:
        return {}

    def _noted(self) -> dict:
        held = _Folder(self.folder)
        try:
            with held.files.open_input_file(f"{held.root}/{NOTE}") as f:
                return json.loads(f.read())
        except (OSError, ValueError):
            return {}

    def latestOffset(self) -> dict:
        if self.last is None:
            self.last = self._noted() if self.most else {}
        held, left, out = _Folder(self.folder), self.most, dict(self.last)
        for file, size in held.sizes().items():
            start = out.get(file, 0)
            if left is not None and left <= 0:
                break
            wanted = size if left is None else min(size, start + left)
            end = held.line_end(file, start, wanted, size) if wanted > start else start
            if end > start:
                out[file] = end
                left = None if left is None else left - (end - start)
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.most:
            held = _Folder(self.folder)
            with held.files.open_output_stream(f"{held.root}/{NOTE}") as f:
                f.write(json.dumps(end).encode())
        found = []
        for file, upto in sorted(end.items()):
            begin = start.get(file, 0)
            held = _Folder(self.folder)
            while begin < upto:  # cut at line ends, so that a range needs nothing beyond itself
                stop = held.line_end(file, begin, min(begin + self.split, upto), upto) or upto
                found.append(Range(file, begin, stop if stop > begin else upto))
                begin = found[-1].end
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator:
        return lines(self.folder, partition, whole=True) if partition.file else iter(())

    def commit(self, end: dict) -> None:
        pass


class MessageLog(DataSource):
    """Options: path, splitBytes, maxBytesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def _split(self) -> int:
        return number(self.options.get("splitBytes", str(SPLIT)))

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._split())

    def streamReader(self, schema) -> _Stream:
        most = self.options.get("maxBytesPerTrigger")
        return _Stream(self.options["path"], self._split(), number(most) if most else None)
