"""A tree of named text files, <variant>/<name>.txt, as a data source: each text is a file of its own, whole or not there at all.

A task writes its files into a folder of its own under the tree and lists them; when all tasks are done the driver moves each file to its
place (one move a file is what such a tree costs; millions of texts are better kept by `sinks.write_text_tree` or a table). Tasks that
fail or run twice leave nothing: their folders are cleared with the run's.

Reading, the driver lists the tree once, and tasks read many files each (Spark's own file source makes a task of every 32 small files
at most, and leaves out empty ones).
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

STAGE = "_temporary"
MOST_FILES, MOST_BYTES = 4096, 64 << 20  # of a task that reads
BATCH = 4 << 20  # bytes of texts that a task holds at one time


def open_store(path: str):
    """File system and path within it, of a local path or any address that Arrow knows."""
    from pyarrow import fs

    local = re.sub(r"^file:/*", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local.rstrip("/")
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner.rstrip("/")


def escaped(name: str) -> str:
    """A name as a part of a path: only slashes and percent signs look different, and a first mark that would hide the file."""
    name = name.replace("%", "%25").replace("/", "%2F")
    return f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in ("_", ".") else name


def plain(part: str) -> str:
    """The name that was escaped."""
    return re.sub("^%(?:2E|5F)|%(?:25|2F)", lambda m: chr(int(m[0][1:], 16)), part)


def move_all(store, pairs: list[tuple[str, str]]) -> None:
    """Moves files to their places; calls to a remote store wait for it side by side, local ones are short and gain nothing from threads."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        for old, new in pairs:
            os.replace(old, new)
    else:
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda p: store.move(*p), pairs))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder, and the files in it."""

    folder: str
    files: tuple[str, ...]


class NamedTexts(DataSource):
    """df.write.format("named_texts").mode("append").save(path) and spark.read.format("named_texts").load(path); columns variant, name
    and text, all strings."""

    @classmethod
    def name(cls) -> str:
        return "named_texts"

    def schema(self) -> str:
        return "variant string, name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"variant", "name", "text"} - set(schema.names)
        if missing:
            raise ValueError(f"named texts need the columns {', '.join(sorted(missing))}")
        return NamedTextsWriter(self.options["path"], overwrite)


    def reader(self, schema: StructType) -> DataSourceReader:
        return NamedTextsReader(self.options["path"], int(self.options.get("tasks", 1)))


@dataclass
class Files(InputPartition):
    """Files of one task, by their places in the tree."""

    places: tuple[str, ...]


class NamedTextsReader(DataSourceReader):
    def __init__(self, path: str, tasks: int):
        self.path, self.tasks = path, tasks

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = open_store(self.path)
        tops = [x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and x.base_name[0] not in "._"]
        found = [(f"{top}/{x.base_name}", x.size) for top in tops for x in store.get_file_info(fs.FileSelector(posixpath.join(root, top))) if x.type == fs.FileType.File and x.base_name.endswith(".txt") and x.base_name[0] not in "._"]
        most, parts, size = min(MOST_FILES, -(-len(found) // self.tasks)), [[]], 0
        for place, n in found:
            if parts[-1] and (len(parts[-1]) >= most or size + n > MOST_BYTES):
                parts.append([])
                size = 0
            parts[-1].append(place)
            size += n
        return [Files(tuple(p)) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["variant", "name", "text"])

        for place in partition.places:
            with store.open_input_file(posixpath.join(root, place)) as f:
                text = f.read()
            variant, name = place.split("/")
            rows.append((plain(variant), plain(name[: -len(".txt")]), text.decode(errors="replace")))
            size += len(text)
            if size >= BATCH:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class NamedTextsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, root = open_store(self.path)
        folder = posixpath.join(root, STAGE, self.run, uuid.uuid4().hex)
        files, known = [], set()
        for row in iterator:
            if row.variant is None or row.name is None or row.text is None:
                raise ValueError("a named text has a variant, a name and a text")
            place = f"{escaped(row.variant)}/{escaped(row.name)}.txt"
            top = posixpath.dirname(posixpath.join(folder, place))
            if top not in known:
                store.create_dir(top, recursive=True)
                known.add(top)
            if place in files[-1:] or place in known:
                raise ValueError(f"two texts are named {place}")
            known.add(place)
            with store.open_output_stream(posixpath.join(folder, place)) as out:
                out.write(row.text.encode())
            files.append(place)
        return Written(folder, tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.path)
        done = [m for m in messages if m is not None]
        names = [f for m in done for f in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two texts have one name")
        if self.overwrite:
            from pyarrow import fs

            for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.base_name != STAGE:
                    (store.delete_dir if x.type == fs.FileType.Directory else store.delete_file)(x.path)
        store.create_dir(root, recursive=True)
        for top in {posixpath.dirname(f) for f in names}:
            store.create_dir(posixpath.join(root, top), recursive=True)
        move_all(store, [(posixpath.join(m.folder, f), posixpath.join(root, f)) for m in done for f in m.files])
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        run = posixpath.join(root, STAGE, self.run)
        if store.get_file_info(run).type != fs.FileType.NotFound:
            store.delete_dir(run)
        top = posixpath.join(root, STAGE)
        if store.get_file_info(top).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(top)):
            store.delete_dir(top)


def write_named_texts(df: DataFrame, path: str, variant: str = "variant", name: str = "name", text: str = "text", overwrite: bool = False) -> None:
    """Writes <path>/<variant>/<name>.txt for each row; texts as they are, in UTF-8. Files of other names stay, unless overwritten."""
    df.sparkSession.dataSource.register(NamedTexts)
    rows = df.select(*[F.col(c).cast("string").alias(n) for c, n in ((variant, "variant"), (name, "name"), (text, "text"))])
    rows.write.format("named_texts").mode("overwrite" if overwrite else "append").save(path)


def read_named_texts(spark: SparkSession, path: str) -> DataFrame:
    """The texts of a tree as they were written, empty ones too: variant, name and text. A text that is no UTF-8 has U+FFFD in it."""
    spark.dataSource.register(NamedTexts)
    return spark.read.format("named_texts").option("tasks", 2 * spark.sparkContext.defaultParallelism).load(path)
