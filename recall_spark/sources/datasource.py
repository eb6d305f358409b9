"""Repository files and transcripts as data sources: folders are left out before they are listed, files in partitions of
about equal size, the last lines of a transcript read from its end, and new lines of transcripts as a stream.

spark.dataSource.register(RepositoryFiles), then spark.read.format("repository_files").load(root). Paths are those that
pyarrow opens (local and mounted folders, and stores that it knows); sources.files.repository() reads what only Spark opens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from recall_spark.sources.files import IGNORED, PATTERNS, glob_regex

#: Bytes of files in a partition, about; bytes read at once from the end of a file; bytes of a file that is given whole at most.
PARTITION_BYTES, STEP, FILE_BYTES = 64 << 20, 64 << 10, 256 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def listed(path: str, ignored: tuple[str, ...]) -> Iterator[tuple[str, int]]:
    """Relative path and size of each file, by path; folders of these names are not looked into."""
    files, base = opened(path.rstrip("/") or "/")
    folders = [base]
    while folders:
        at = folders.pop()
        for item in sorted(files.get_file_info(fs.FileSelector(at, allow_not_found=False)), key=lambda i: i.path, reverse=True):
            if item.type == fs.FileType.Directory:
                if item.base_name not in ignored:
                    folders.append(item.path)
            elif item.base_name not in ignored:
                yield item.path[len(base) :].lstrip("/"), item.size or 0


class Files(InputPartition):
    """Files of a partition: (path, begin, end)."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = spans


def dealt(spans: list[tuple[str, int, int]], size: int) -> list[Files]:
    """Partitions of about so many bytes, in the order of files."""
    parts: list[list] = []
    room = 0
    for span in spans:
        if not parts or room < span[2] - span[1]:
            parts.append([])
            room = size
        parts[-1].append(span)
        room -= span[2] - span[1]
    return [Files(p) for p in parts]


class RepositoryFiles(DataSource):
    """path, length, content, sha256 of files below a folder. Options: patterns and ignored (comma-separated), maxFiles (the
    first by path), partitionBytes, maxFileBytes (content and sha256 of larger files are null: they aren't read)."""

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return "path string, length long, content binary, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _RepositoryReader(dict(self.options))


def _names(value: str | None, default: tuple[str, ...]) -> tuple[str, ...]:
    return default if value is None else tuple(x for x in value.split(",") if x)


class _RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.size, self.most = low["path"], int(low.get("partitionbytes", PARTITION_BYTES)), low.get("maxfiles")
        self.longest = int(low.get("maxfilebytes", FILE_BYTES))
        self.ignored = _names(low.get("ignored"), IGNORED)
        self.wanted = "|".join(map(glob_regex, _names(low.get("patterns"), PATTERNS)))

    def partitions(self) -> list[Files]:
        found = sorted((p, 0, n) for p, n in listed(self.path, self.ignored) if re.fullmatch(self.wanted, p))
        return dealt(found[: int(self.most)] if self.most is not None else found, self.size) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, base = opened(self.path.rstrip("/") or "/")
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("sha256", pa.string())])
        for path, _, size in partition.spans:
            content = None
            if size <= self.longest:
                with files.open_input_stream(f"{base}/{path}") as f:
                    content = f.read()
            yield pa.RecordBatch.from_pylist([{"path": path, "length": size, "content": content, "sha256": content if content is None else hashlib.sha256(content).hexdigest()}], schema)


def last_lines(files: fs.FileSystem, path: str, most: int, end: int | None = None) -> list[str]:
    """The last lines of a file, read in steps from its end; bytes before them are not read."""
    with files.open_input_file(path) as f:
        at = end if end is not None else f.size()
        tail = b""
        while at > 0 and tail.rstrip(b"\n").count(b"\n") < most:
            step = min(STEP, at)
            at -= step
            f.seek(at)
            tail = f.read(step) + tail
    lines = tail.rstrip(b"\n").split(b"\n") if tail.strip(b"\n") else []
    return [x.decode(errors="replace") for x in lines[-most:]]


class Transcripts(DataSource):
    """session_id (the file's name without .jsonl), line_no, line of transcripts below a folder.

    Read: the last lines of each file (option lines, 200), the last one with line_no -1. As a stream: whole new lines as files
    grow, in the order of their bytes (line_no is where a line begins), from the beginning of what is there or, with
    startingOffset=latest, from its end."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return "session_id string, line_no long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _TailReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _NewLines(dict(self.options))


_LINES = pa.schema([("session_id", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])


def _session(path: str) -> str:
    return path.removesuffix(".jsonl")


class _TailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.most, self.size = low["path"], int(low.get("lines", 200)), int(low.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        # A file counts for what is read of it at least: its last step.
        found = sorted((p, max(0, n - STEP), n) for p, n in listed(self.path, IGNORED) if p.endswith(".jsonl"))
        return dealt(found, self.size) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, base = opened(self.path.rstrip("/") or "/")
        for path, _, _ in partition.spans:
            lines = last_lines(files, f"{base}/{path}", self.most)
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([_session(path)] * len(lines)), pa.array(range(-len(lines), 0), pa.int64()), pa.array(lines)], schema=_LINES)


class _NewLines(DataSourceStreamReader):
    """Offsets are, for each file, the end of its last whole line."""

    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.size, self.latest = low["path"], int(low.get("partitionbytes", PARTITION_BYTES)), low.get("startingoffset") == "latest"

    def _ends(self) -> dict[str, int]:
        files, base = opened(self.path.rstrip("/") or "/")
        out = {}
        for path, size in sorted(listed(self.path, IGNORED)):
            if not path.endswith(".jsonl"):
                continue
            with files.open_input_file(f"{base}/{path}") as f:
                at = size
                while at > 0:
                    step = min(STEP, at)
                    f.seek(at - step)
                    found = f.read(step).rfind(b"\n")
                    if found >= 0:
                        at += found + 1 - step
                        break
                    at -= step
            out[path] = at
        return out

    def initialOffset(self) -> dict:
        return {"files": json.dumps(self._ends() if self.latest else {})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._ends())}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        # A file that is shorter than it was has been written anew.
        spans = [(p, before.get(p, 0) if before.get(p, 0) <= n else 0, n) for p, n in now.items()]
        return dealt([s for s in spans if s[2] > s[1]], self.size) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, base = opened(self.path.rstrip("/") or "/")
        for path, begin, end in partition.spans:
            with files.open_input_file(f"{base}/{path}") as f:
                f.seek(begin)
                left = b""
                at = begin
                while at < end:
                    part = f.read(min(1 << 20, end - at))
                    if not part:
                        break
                    whole, mark, rest = (left + part).rpartition(b"\n")
                    first = at - len(left)
                    at += len(part)
                    left = rest
                    if mark:
                        lines, places = [], []
                        for line in whole.split(b"\n"):
                            lines.append(line.decode(errors="replace"))
                            places.append(first)
                            first += len(line) + 1
                        yield pa.RecordBatch.from_arrays([pa.array([_session(path)] * len(lines)), pa.array(places, pa.int64()), pa.array(lines)], schema=_LINES)

    def commit(self, end: dict) -> None:
        pass
