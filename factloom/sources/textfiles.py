"""A data source of text files: a row per file when read, a file per row when written.

    spark.dataSource.register(TextFiles)
    spark.read.format("text_documents").option("extensions", "txt,md").load(folder)
    rows.write.format("text_documents").mode("append").save(folder)

Files are read in groups of about groupBytes, in order of path, from any file
system that Arrow can open by its URI; read_text_documents reads the others
through Spark.  A file is UTF-8, else Latin-1; its lines end with a line feed.
Files and folders whose names start with a dot are left out; an empty file
gives an empty text, a folder without files no rows, a missing one an error.

Rows to write have a filename and a text (written as UTF-8) or a content
(written as it is); null counts as empty, other columns are left out.  Each task
fills a hidden folder of its own, which the commit renames, so that a task run
twice, or a job that fails, leaves nothing to be read.  A name with a slash, no
name, or a name twice in one task is an error.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, filename string, title string, text string, encoding string, extension string, length long"
GROUP_BYTES = 32 << 20
GROUP_FILES = 4096
BATCH_CHARS = 4 << 20

_ARROW = pa.schema([(c, pa.string()) for c in ("path", "filename", "title", "text", "encoding", "extension")] + [("length", pa.int64())])


def split_name(name: str) -> tuple[str, str]:
    """(stem, extension in lower case): a leading or final dot starts no extension."""
    stem, _, end = name.rpartition(".")
    return (stem, end.lower()) if stem and end else (name, "")


def decoded(raw: bytes) -> tuple[str, str]:
    try:
        text, encoding = raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        text, encoding = raw.decode("latin-1"), "latin-1"
    return text.replace("\r\n", "\n").replace("\r", "\n"), encoding


@dataclass
class Group(InputPartition):
    paths: list[str]


@dataclass
class Filled(WriterCommitMessage):
    folder: str
    files: int


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.bytes = int(options.get("groupBytes", GROUP_BYTES))
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.extensions = {e.strip().lower().lstrip(".") for e in options.get("extensions", "").split(",") if e.strip()}

    def _wanted(self, root: str, info: fs.FileInfo) -> bool:
        inside = info.path[len(root) :].strip("/") or info.base_name
        hidden = any(p.startswith(".") for p in inside.split("/"))
        return info.type == fs.FileType.File and not hidden and (not self.extensions or split_name(info.base_name)[1] in self.extensions)

    def partitions(self) -> list[Group]:
        store, root = fs.FileSystem.from_uri(self.uri)
        one = store.get_file_info(root)
        found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        groups, size = [], 0
        for info in sorted((i for i in found if self._wanted(root, i)), key=lambda i: i.path):
            if not groups or size + info.size > self.bytes or len(groups[-1].paths) == GROUP_FILES:
                groups.append(Group([]))
                size = 0
            groups[-1].paths.append(info.path)
            size += info.size
        return groups

    def read(self, partition: Group | None) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        rows, held = [], 0
        for path in partition.paths if partition else ():
            with store.open_input_stream(path) as file:
                text, encoding = decoded(file.read())
            name = posixpath.basename(path)
            title, extension = split_name(name)
            rows.append({"path": path, "filename": name, "title": title, "text": text, "encoding": encoding, "extension": extension, "length": len(text)})
            held += len(text)
            if held > BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        names = schema.fieldNames()
        self.column = next((c for c in ("content", "text") if c in names), None)
        if "filename" not in names or self.column is None:
            raise ValueError("rows need a filename and a text or content")
        self.uri, self.job = options["path"], uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        store, root = fs.FileSystem.from_uri(self.uri)
        return store, root, posixpath.join(root, f".writing-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Filled:
        store, _, staging = self._staging()
        own, names = f"part-{uuid.uuid4().hex}", set()
        folder = posixpath.join(staging, own)
        store.create_dir(folder)
        for batch in iterator:
            for name, body in zip(batch.column("filename").to_pylist(), batch.column(self.column).to_pylist()):
                if not name or "/" in name or name in (".", "..") or name in names:
                    raise ValueError(f"not a name of its own for a file: {name!r}")
                names.add(name)
                with store.open_output_stream(posixpath.join(folder, name)) as file:
                    file.write(body.encode() if isinstance(body, str) else bytes(body or b""))
        return Filled(own, len(names))

    def commit(self, messages: list[Filled | None]) -> None:
        store, root, staging = self._staging()
        store.create_dir(root)
        for m in messages:
            if m and m.files:
                store.move(posixpath.join(staging, m.folder), posixpath.join(root, m.folder))
        self.abort(messages)

    def abort(self, messages: list[Filled | None]) -> None:
        store, _, staging = self._staging()
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("text files are only added: name a new folder, or append")
        return Writer(self.options, schema)
